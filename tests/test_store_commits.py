"""Two writers at once, sites with odd names, and plans that do not grow with steps."""

import pytest
from pyspark.sql import functions as F

from stockledger import schemas
from stockledger.params import LedgerWindow
from stockledger.sinks.snapshot_store import DELTA, Conflict, SnapshotStore
from stockledger.streaming import refresh
from stockledger.streaming.refresh import _Seen, delta_refresh, full_refresh
from tests.conftest import CLOSING, dimensions, item, rows, sale, split, unit

DAY, MOMENT = "2024-03-31", "2024-03-01 00:00:00"


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def snapshot(spark, *sites, stok=10.0):
    texts = {c: "x" for c, t in schemas.SNAPSHOT.items() if t == "string"}
    values = [{**{c: 0.0 for c in schemas.SNAPSHOT}, **texts, "server_key": s, "kd_barang": "1", "stok_akhir": stok} for s in sites]
    return spark.createDataFrame([tuple(v[c] for c in schemas.SNAPSHOT) for v in values], schemas.ddl(schemas.SNAPSHOT))


def change(spark, *sites, qty=1):
    frame = spark.createDataFrame([(s, "x", "1") for s in sites], "server_key string, kd_divisi string, kd_barang string")
    return frame.withColumn("delta_stok", F.lit(qty).cast(DELTA["delta_stok"]))


def test_of_two_changes_from_one_state_one_is_published(spark, store):
    store.publish(snapshot(spark, "a"), DAY, MOMENT)
    seen = store.states("one"), store.states("two")
    assert store.append_delta(["a"], change(spark, "a"), "one", None, states=seen[0]) == ["a"]
    with pytest.raises(Conflict):
        store.append_delta(["a"], change(spark, "a", qty=5), "two", None, states=seen[1])
    assert rows(store.read(), "stok_akhir") == [(11.0,)]
    assert store.append_delta(["a"], change(spark, "a", qty=5), "two", None) == ["a"]
    assert rows(store.read(), "stok_akhir") == [(16.0,)]


def test_a_change_to_a_version_that_is_replaced_meanwhile_is_refused(spark, store):
    store.publish(snapshot(spark, "a"), DAY, MOMENT)
    seen = store.states("one")
    store.compact("a")
    with pytest.raises(Conflict):
        store.append_delta(["a"], change(spark, "a"), "one", None, states=seen)
    assert rows(store.read(), "stok_akhir") == [(10.0,)]


def test_two_full_refreshes_give_two_versions(spark, store, monkeypatch):
    store.publish(snapshot(spark, "a"), DAY, MOMENT)
    stale = store.states()
    assert store.publish(snapshot(spark, "a", stok=20.0), DAY, MOMENT) == {"a": 2}
    monkeypatch.setattr(store, "states", lambda batch_id=None: stale)
    assert store.publish(snapshot(spark, "a", stok=30.0), DAY, MOMENT) == {"a": 3}
    monkeypatch.undo()
    assert rows(store.read(), "stok_akhir") == [(30.0,)]
    assert rows(store.meta(), "number", "version") == [(1, 1), (2, 2), (3, 3)]


def test_a_compaction_folds_in_what_came_first(spark, store, monkeypatch):
    store.publish(snapshot(spark, "a"), DAY, MOMENT)
    publish, first = store._publish, []

    def overtaken(row):
        if row["kind"] == "compact" and not first:
            first.append(row)
            store.append_delta(["a"], change(spark, "a"), "one", None)
        publish(row)

    monkeypatch.setattr(store, "_publish", overtaken)
    store.compact("a")
    assert rows(store.read(), "stok_akhir") == [(11.0,)] and store.state("a")["number"] == 3


def test_refreshes_at_once_count_each_document_once(spark, tables, store, monkeypatch):
    source = tables(
        **dimensions(),
        m_barang=[item("1")],
        m_barang_satuan=[unit("1", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 100}],
        **split("t_penjualan", [sale("s", "A", "1", 7, server="2024-03-20 00:00:00")]),
    )
    window = LedgerWindow(CLOSING, DAY)
    full_refresh(store, source, window, MOMENT)
    once, overtaken = refresh._delta_refresh, []

    def slow(store_, source_, window_, until, key):
        if not overtaken:
            overtaken.append(True)
            real = store_.append_delta

            def append(*args, **more):
                monkeypatch.setattr(store_, "append_delta", real)
                assert once(store_, source_, window_, "2024-04-02 00:00:00", key) == "delta"
                return real(*args, **more)

            monkeypatch.setattr(store_, "append_delta", append)
        return once(store_, source_, window_, until, key)

    monkeypatch.setattr(refresh, "_delta_refresh", slow)
    assert delta_refresh(store, source, window, "2024-04-01 00:00:00") == "unchanged"
    assert rows(store.read(), "stok_akhir") == [(93.0,)]


def test_sites_of_any_name_and_one_relation(spark, store):
    sites = ["a", "b c", "ä/ö=1", "50%+x", "x:y?[z]", "%41"]
    assert set(store.publish(snapshot(spark, *sites), DAY, MOMENT)) == set(sites)
    for n in range(3):
        assert store.append_delta(sites, change(spark, *sites), f"batch {n}", None) == sites
    found = store.read()
    assert rows(found, "server_key", "stok_akhir") == sorted((s, 13.0) for s in sites)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" parquet" in line for line in plan.splitlines()) == 2
    for site in sites:
        assert rows(store.read(site), "server_key", "stok_akhir") == [(site, 13.0)]
        store.compact(site)
    assert rows(store.read(), "server_key", "stok_akhir") == sorted((s, 13.0) for s in sites)


def test_a_site_without_rows(spark, store):
    store.publish(snapshot(spark), DAY, MOMENT, server_keys=["a"])
    assert store.read().count() == 0 and store.state("a")["row_count"] == 0


def test_what_a_feed_brings(spark):
    feed = spark.createDataFrame([("a", 1), ("a", 2)], "server_key string, x int")
    seen = _Seen(feed, ["a", "b"])
    seen.rows.count()
    assert (seen.count("a"), seen.count("b")) == (2, 0)
    # A feed without rows is left out of the plan, so nothing is observed.
    seen = _Seen(feed.where("false"), ["a"])
    seen.rows.groupBy("server_key").count().collect()
    assert seen.count("a") == 0
    strange = _Seen(feed, ["b"])
    strange.rows.count()
    with pytest.raises(LookupError):
        strange.count("b")
