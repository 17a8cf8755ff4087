"""URL filter and WARC archives."""

import base64
import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from kerbwise.llm import url_filter, warc
from kerbwise.llm.queries import URL_RULES

RULES = [url_filter.host_rule(v, r) for v, r in URL_RULES] + [url_filter.word_rule(w) for w in url_filter.BLOCK_WORDS]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.NET/x", "https://example.net/en/", "https://A.Example.Net/en/1?q#f",
    "https://example.net/enx", "https://notexample.net/en/", "http://example.com/de/1", "http://example.com/DE/1", "http://x.org/fr/", "http://x.org/fr?/fr/",
    "http://x.org#/fr/", "http://my-casino.example.org/en/1", "http://casinos.org/", "http://x.com/casino/", "http://free.bets.com", "a://b://c.net/", "http://x.com/\nnet/",
    "http://ünï.example.net/en/ß", "http://" + "a" * 100_000 + ".net/" + "b" * 100_000,
]


def _judge(url):
    """All rules tried one after another."""
    rest = (url or "").partition("://")
    host = re.split("[/?#]", rest[2])[0] if rest[1] else ""
    path = re.split("[?#]", rest[2][len(host) :])[0] if rest[1] else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = set(re.split("[.-]", host)) & set(url_filter.BLOCK_WORDS)
    return host, path, None, "block" if blocked else "allow"


def test_url_filter_equals_trying_every_rule(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], None)], "page_id long, url string, host string")
    got = url_filter.url_filter(df, RULES)
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == _judge(URLS[r.page_id]), URLS[r.page_id]
    assert got.count() == len(URLS) + 1
    assert url_filter.url_filter(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, []).collect()} == {"allow"}


def test_rules_are_indexed_by_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.common.rare", "/x/"), ("b.common", "/x/")], "host string, path string")
    rules = [url_filter.host_rule("block", "common.rare/x/"), url_filter.host_rule("block", "unseen.common/x/"), url_filter.PatternRule("any", "^", "allow", ())]
    counts = url_filter.token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    assert counts == {"common": 2, "rare": 1, "x": 2}
    assert url_filter.index_rules(rules, counts) == ({"rare": [0], "unseen": [1]}, [2])
    few = url_filter.url_filter(spark.createDataFrame([(1, "http://b.common/x/")], "page_id long, url string"), rules[:2])
    assert few.first().tried == 0


def _digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://b/ x\r\n", "same"), (3, "u", None), (4, "u", ""), (None, "u", "ünique"), (5, "u", "x" * 3_000_000), (9, "http://b/", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).repartition(3)
    manifest = warc.write_archives(df, warc.archive_folder(df), archive_bytes=200)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    got = warc.read_archives(manifest, with_payload=True).collect()
    assert len(got) == len(pages) and not [r for r in got if r.kind == "gap"]
    same = [r for r in got if r.payload_digest == _digest(b"same")]
    assert sorted((r.kind, r.page_id, r.refers_to) for r in same if r.kind == "revisit") == [("revisit", 1, 9), ("revisit", 2, 9), ("revisit", 9, 9)]
    assert [(r.page_id, r.payload) for r in same if r.kind == "response"] == [(9, bytearray(b"same"))] and {r.payload_bytes for r in same} == {4}
    blank = {r.page_id: (r.kind, r.refers_to, r.payload_bytes) for r in got if r.payload_digest == _digest(b"")}
    assert blank == {4: ("response", None, 0), 3: ("revisit", 4, 0)}
    assert [(r.page_id, r.payload.decode()) for r in got if r.payload_bytes == 7] == [(None, "ünique")]
    kept = warc.read_archives(warc.write_archives(df, warc.archive_folder(df), revisit_min_bytes=5))
    assert {r.kind for r in kept.collect()} == {"response"}
    none = warc.write_archives(df.limit(0), warc.archive_folder(df))
    assert warc.read_archives(none).count() == 0


def _file(n=6, plain=False):
    parts = [warc.record(i, "http://a/", f"payload {i} ".encode() * 40, warc.payload_digest(f"payload {i} ".encode() * 40), None, False) for i in range(n)]
    return parts if plain else [gzip.compress(p) for p in parts]


def _salvaged(data):
    found = list(warc.salvage(io.BytesIO(data)))
    records = [int(re.findall(r"\d+", x.headers["warc-record-id"])[0]) for x in found if isinstance(x, warc.Record)]
    gaps = [(x.start, x.end) for x in found if isinstance(x, warc.Gap)]
    covered = sorted({(x.start, x.end) for x in found})
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    return records, gaps


def test_salvage_recovers_later_records():
    for plain in (False, True):
        parts = _file(plain=plain)
        offsets = [sum(map(len, parts[:i])) for i in range(7)]
        whole = b"".join(parts)
        assert _salvaged(whole) == ([0, 1, 2, 3, 4, 5], [])
        flipped = bytearray(whole)
        flipped[offsets[2] + len(parts[2]) // 2] ^= 0xFF  # a damaged block
        assert _salvaged(bytes(flipped)) == ([0, 1, 3, 4, 5], [(offsets[2], offsets[3])])
        cut = whole[: offsets[3] + 30] + whole[offsets[4] :]  # a torn record
        assert _salvaged(cut) == ([0, 1, 2, 4, 5], [(offsets[3], offsets[3] + 30)])
        assert _salvaged(whole[: offsets[5] + 40])[0] == [0, 1, 2, 3, 4]  # a torn end
        noise = b"\x00garbage WARC/1.1\r\nnot a record\r\n\r\n\x1f\x8b\x08junk" * 3
        assert _salvaged(noise + whole) == ([0, 1, 2, 3, 4, 5], [(0, len(noise))])
        assert _salvaged(b"".join(parts[:2]) + noise + b"".join(parts[2:]))[0] == [0, 1, 2, 3, 4, 5]
    assert _salvaged(noise) == ([], [(0, len(noise))])
    assert list(warc.salvage(io.BytesIO(b""))) == []


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_a_member_of_several_records_loses_only_damaged_ones(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    parts = _file(5, plain=True)
    hurt = bytearray(b"".join(parts))
    hurt[len(parts[0]) + len(parts[1]) - 60] ^= 0xFF
    member = gzip.compress(bytes(hurt))
    assert _salvaged(member + gzip.compress(parts[0])) == ([0, 2, 3, 4, 0], [(0, len(member))])
    gap = next(x for x in warc.salvage(io.BytesIO(member)) if isinstance(x, warc.Gap))
    assert gap.inner == (len(parts[0]), len(parts[0]) + len(parts[1]))

    torn = bytearray(gzip.compress(b"".join(parts)))
    torn[-6] ^= 0xFF  # the checksum
    assert _salvaged(bytes(torn)) == ([0, 1, 2, 3, 4], [(0, len(torn))])
    assert _salvaged(bytes(torn) + gzip.compress(parts[0])) == ([0, 1, 2, 3, 4, 0], [(0, len(torn))])
    assert _salvaged(bytes(torn[:-8]) + bytes(torn)) == ([0, 1, 2, 3, 4] * 2, [(0, len(torn) - 8), (len(torn) - 8, 2 * len(torn) - 8)])
    noise = [random.Random(i).randbytes(3000) for i in range(5)]
    big = [warc.record(i, "u", n, warc.payload_digest(n), None, False) for i, n in enumerate(noise)]
    cut = gzip.compress(b"".join(big))
    cut = cut[: len(cut) * 7 // 10]
    assert _salvaged(cut) == ([0, 1, 2], [(0, len(cut))])
    unstated = re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", b"".join(parts))
    bare = bytearray(gzip.compress(unstated))
    assert _salvaged(bytes(bare)) == ([0, 1, 2, 3, 4], [])
    bare[-6] ^= 0xFF  # without digests nothing vouches for the records
    assert _salvaged(bytes(bare)) == ([], [(0, len(bare))])


def test_search_across_blocks(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 50)
    parts = _file(4)
    noise = b"x" * 1234
    assert _salvaged(noise + b"".join(parts)) == ([0, 1, 2, 3], [(0, 1234)])


def test_urls_that_end_like_a_version_line(spark):
    pages = [(1, "http://a/WARC/1.0", "same"), (2, "http://a/?q=WARC/1.1", "other"), (3, "http://b/", "same"), (9, "http://a/WARC/1.1", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.read_back(warc.write_archives(df, warc.archive_folder(df)))
    assert sorted((r.page_id, r.url, r.kind, r.refers_to) for r in got.collect()) == [
        (1, "http://a/WARC/1.0", "revisit", 9), (2, "http://a/?q=WARC/1.1", "response", None), (3, "http://b/", "revisit", 9), (9, "http://a/WARC/1.1", "response", None),
    ]


def test_a_record_torn_anywhere_in_its_header_is_told_from_the_next():
    parts = [warc.record(i, f"http://a/{i}/WARC/1.1", b"text %d" % i, warc.payload_digest(b"text %d" % i), None, False) for i in range(3)]
    for n in range(1, parts[1].index(b"\r\n\r\n")):
        assert _salvaged(parts[0] + parts[1][:n] + parts[2]) == ([0, 2], [(len(parts[0]), len(parts[0]) + n)]), n


def test_a_record_lost_on_reading_back_is_an_error(spark):
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    manifest = warc.write_archives(df, warc.archive_folder(df))
    with pytest.raises(RuntimeError, match="2 records were written and 1 read back"):
        warc.read_back(manifest.withColumn("records", F.lit(2).cast("long")))
