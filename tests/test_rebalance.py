"""Rebalancing of the store's shards."""

from collections import Counter

from hypothesis import given, settings, strategies as st

from cairn.operators.store import SLOTS, ParquetStore, plan_moves
from cairn.plans import store_queries
from cairn.plans.registry import store


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.lists(st.tuples(st.integers(0, 6 * SLOTS - 1), st.integers(1, 500)), max_size=60), st.sampled_from([0.0, 0.1, 0.3]))
def test_moves_only_make_it_more_even(shards, rows, threshold):
    sizes = {(slot % (shards * SLOTS), slot % shards): n for slot, n in rows}
    moves, before, after = plan_moves(sizes, shards, threshold)
    total = Counter({i: 0 for i in range(shards)})
    for (slot, shard), n in sizes.items():
        total[moves.get(slot, shard)] += n
    even = (max(total.values()) - min(total.values())) * shards / sum(total.values()) if sizes else 0.0
    assert abs(even - after) < 1e-9 and after <= before + 1e-9
    assert moves == {} if before <= threshold else True
    largest = max(sizes.values(), default=0)
    assert after <= max(threshold, largest * shards / max(1, sum(sizes.values()))) + 1e-9


def test_query(spark, small):
    rows = store_queries.store_rebalance(spark, small).collect()
    import hashlib

    first = lambda source: int(hashlib.md5(source.encode()).hexdigest(), 16) % 4
    want = {(r.id, r.source) for r in store(spark, small).select("id", "source").collect() if first(r.source) not in (1, 2) or r.id % 4 == 0}
    assert {(r.id, r.source) for r in rows} == want and len(rows) == len(want)
    by = Counter(r.shard for r in rows)
    assert (max(by.values()) - min(by.values())) * 4 / len(rows) <= 0.2 and {(r.status, r.balanced) for r in rows} == {("done", True)}
    assert {r.moved_rows for r in rows} == {sum(r.shard != first(r.source) for r in rows)} and 0 < rows[0].moved_rows < len(rows) / 2


def test_changes_after_rebalancing_find_their_rows(spark, tmp_path):
    """Routes hold for reads, replacements, deletions and compaction; a source of most rows stays whole."""
    own = ParquetStore(spark, str(tmp_path / "s"), shards=3)
    names = [f"/f{i}.md" for i in range(60)]
    put = lambda pairs: spark.createDataFrame([(i, s, c, [1.0, 2.0]) for i, s, c in pairs], "id long, source string, content string, vector array<double>")
    assert own.rebalance()["status"] == "skipped"
    own.add(put([(i, names[i % 60], "old") for i in range(240)]))
    lone = own._shard(names[0])
    own.remove_ids(own.df().where(f"shard <> {lone} and id >= 60").select("id"))
    before = {tuple(r) for r in own.df().select("id", "source").collect()}
    done = own.rebalance(0.1)
    assert done["status"] == "done" and done["imbalance"] > 0.5 and 0 < done["moved_rows"] < len(before)
    assert {tuple(r) for r in own.df().select("id", "source").collect()} == before and own.rebalance(0.1)["moved_rows"] == 0
    moved = next(s for s in names if own._shard(s) != lone and any(x[1] == s and x[0] >= 60 for x in before))
    assert {r.id for r in own.source_rows(moved).collect()} == {i for i, s in before if s == moved}
    own.replace(put([(1000, moved, "new")]))
    assert [(r.id, r.shard) for r in own.source_rows(moved).collect()] == [(1000, own._shard(moved))]
    own.upsert(put([(1000, moved, "newer")]))
    own.compact()
    assert [r.content for r in own.source_rows(moved).collect()] == ["newer"]
    assert own.delete_file(moved) == 1 and not own.file_exists(moved)
    assert own.df().count() == len({x for x in before if x[1] != moved})
    hot = ParquetStore(spark, str(tmp_path / "h"), shards=3)
    hot.add(put([(i, "/hot.md" if i % 4 else names[i % 60], "x") for i in range(120)]))
    out = hot.rebalance(0.1)
    assert out["status"] == "partial" and out["after"] <= out["imbalance"] and {r.shard for r in hot.df().where("source = '/hot.md'").collect()} == {hot._shard("/hot.md")}
