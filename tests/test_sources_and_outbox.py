"""Landed pages as a data source, batch and stream; deliveries over failures."""

from __future__ import annotations

import json
import os
import tempfile

import pytest

from hearthline.sources import market
from hearthline.sources.outbox import Marks, Outbox


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="hearthline-test-")


def ident(k):
    return f"{k:024x}"


def land(folder, name, page, ids, follow=None):
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    items = [{"position": i, "url": f"https://m.rs/stan/{ident(k)}?x=1", "name": f"Stan &amp; {k}"} for i, k in enumerate(ids)]
    links = "".join(f'<a href="/{name}?strana={n}">{n}</a>' for n in (follow or []))
    with open(f"{folder}/{name}/{page}.html", "w") as f:
        f.write(f'<html>{links}<script type="application/ld+json">{json.dumps({"@type": "ItemList", "itemListElement": items})}</script><script type="application/ld+json">broken</script></html>')


def read(spark, folder, **options):
    market.register(spark)
    rows = spark.read.format("listing_pages").option("path", folder).options(**options).load().collect()
    cards = sorted((r.market, r.page, r.external_id) for r in rows if r.external_id)
    return cards, {r.market: r.complete for r in rows if r.external_id is None}


def test_pages_are_followed_to_their_end(spark, folder):
    land(folder, "beograd", 1, [1, 2, 3], [2, 3])
    land(folder, "beograd", 2, [3, 4], [1, 3])
    land(folder, "beograd", 3, [5], [1, 2])
    land(folder, "zemun", 1, [7], [2])
    land(folder, "vracar", 1, [8], [1])
    cards, complete = read(spark, folder)
    assert cards == [("beograd", 1, ident(1)), ("beograd", 1, ident(2)), ("beograd", 1, ident(3)), ("beograd", 2, ident(4)), ("beograd", 3, ident(5)), ("vracar", 1, ident(8)), ("zemun", 1, ident(7))]
    assert complete == {"beograd": True, "zemun": False, "vracar": True}
    assert read(spark, folder, max_pages=1)[1] == {"beograd": False, "zemun": False, "vracar": True}


def test_known_cards_end_a_market(spark, folder):
    land(folder, "beograd", 1, [1, 2, 3, 4, 5], [2])
    land(folder, "beograd", 2, [6], [1])
    with open(f"{folder}/known.txt", "w") as f:
        f.write("\n".join(ident(k) for k in (2, 3, 4)))
    cards, complete = read(spark, folder, known=f"{folder}/known.txt", known_stop=2)
    assert [c[2] for c in cards] == [ident(1), ident(2), ident(3)] and complete == {"beograd": True}


def test_the_stream_gives_the_batch_s_cards(spark, folder):
    market.register(spark)
    pages = f"{folder}/pages"
    land(pages, "beograd", 1, [1, 2], [2])
    land(pages, "zemun", 1, [7])

    def run():
        frame = spark.readStream.format("listing_pages").option("path", pages).load()
        query = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(once=True).start()
        query.awaitTermination()
        return [(r.market, r.page, r.external_id, r.complete) for r in spark.read.schema(market.SCHEMA).parquet(f"{folder}/out").collect()]

    run()
    land(pages, "beograd", 2, [3, 4], [1, 3])
    run()
    land(pages, "beograd", 3, [5], [1])
    rows = run()
    rows = run()
    cards, complete = read(spark, pages)
    assert sorted(r[:3] for r in rows if r[2]) == cards and len(rows) == len(set(rows))
    assert {r[0]: r[3] for r in rows if r[2] is None} == complete == {"beograd": True, "zemun": True}


ALERT = "dedupe_key string, message string"


def sender(folder, broken=(), dies=()):
    """Notes what goes out in a file a message; refuses some, and takes the task down after others have gone out."""

    def send(row):
        name = f"{folder}/{row['dedupe_key']}"
        if row["dedupe_key"] in broken and not os.path.exists(f"{folder}/mended"):
            raise OSError("no route")
        with open(f"{name}.{len([f for f in os.listdir(folder) if f.startswith(row['dedupe_key'] + '.')])}", "w") as f:
            f.write(row["message"])
        if row["dedupe_key"] in dies and not os.path.exists(f"{folder}/mended"):
            raise SystemExit("the executor is lost")
        return True

    return send


def sent(folder):
    return sorted(f for f in os.listdir(folder) if "." in f)


def test_refused_alerts_are_tried_three_times(spark, folder):
    out = f"{folder}/out"
    os.makedirs(out)
    box = Outbox(spark, f"{folder}/box", sender(out, broken=["b"]))
    alerts = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1"), (None, "x")], ALERT)
    for batch in range(5):
        box.apply(alerts, batch)
    assert sent(out) == ["a.0"]
    assert {r.dedupe_key: (r.status, r.attempts) for r in box.states().collect()} == {"a": ("SENT", 1), "b": ("FAILED", 3)}


def test_a_batch_that_dies_sends_nothing_twice(spark, folder):
    out = f"{folder}/out"
    os.makedirs(out)
    box = Outbox(spark, f"{folder}/box", sender(out, dies=["c"]))
    alerts = spark.createDataFrame([(k, k) for k in "abcd"], ALERT).coalesce(1)
    with pytest.raises(Exception):
        box.apply(alerts, 0)
    open(f"{out}/mended", "w").close()
    box.apply(alerts, 0)
    box.apply(alerts, 0)
    states = {r.dedupe_key: r.status for r in box.states().collect()}
    assert states == {"a": "SENT", "b": "SENT", "c": "UNCERTAIN", "d": "SENT"} and sent(out) == ["a.0", "b.0", "c.0", "d.0"]
    box.apply(alerts, 1)
    assert sent(out) == ["a.0", "b.0", "c.0", "d.0"]
    box.release(spark.createDataFrame([("c",)], "dedupe_key string"))
    assert not Marks(f"{folder}/box/marks").has("c", "claimed")
    box.apply(alerts, 9)
    assert sent(out) == ["a.0", "b.0", "c.0", "c.1", "d.0"]


def test_outbox_as_a_stream(spark, folder):
    out = f"{folder}/out"
    os.makedirs(out)
    box = Outbox(spark, f"{folder}/box", sender(out))
    for keys in ("ab", "bc"):
        spark.createDataFrame([(k, k) for k in keys], ALERT).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        box.run_available(spark.readStream.schema(ALERT).parquet(f"{folder}/landed"))
    assert sent(out) == ["a.0", "b.0", "c.0"]
