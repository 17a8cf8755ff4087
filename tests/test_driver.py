"""The driver: pieces of work at the same time are bounded, and its garbage is collected between them."""

import threading
import time

from kerbwise import session


def test_no_more_pieces_at_once_than_set_and_the_first_first(spark):
    lock, running, most, order = threading.Lock(), [0], [0], []

    def piece(name):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            order.append(name)
        time.sleep(0.3)
        with lock:
            running[0] -= 1
        return name

    names = [f"p{i:02d}" for i in range(2 * session.AT_ONCE + 1)]
    got = session.together(spark, **{n: lambda n=n: piece(n) for n in names})
    assert got == {n: n for n in names} and 1 < most[0] <= session.AT_ONCE
    assert set(order[: session.AT_ONCE]) == set(names[: session.AT_ONCE]) and order[-1] in names[-session.AT_ONCE :]


def test_garbage_is_collected_from_a_share_of_the_heap_on(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def full():
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    monkeypatch.setattr(session, "HEAP_SHARE", 1.1)
    session.ease_driver(spark)
    before = full()
    session.ease_driver(spark)
    assert full() == before
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0)
    session.ease_driver(spark)
    assert full() > before
