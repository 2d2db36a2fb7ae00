"""Invariants of the results no SQL oracle states (model training, ALS,
hybrid), BM25 against a brute-force scorer, and the library pieces that
are not registered queries (seeded generators, incremental upsert, the
block top-k kernel)."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

import __spark_entry__ as E


def _run(spark, key):
    return E.queries()[key](spark, SF_SMALL)


# ---------------------------------------------------------------------------
# Forecaster
# ---------------------------------------------------------------------------


def test_forest_metrics_are_sane(spark):
    (r,) = _run(spark, "demand_rf_metrics").collect()
    assert r.train_samples > 0 and r.test_samples > 0
    assert 0 <= r.mae <= r.rmse  # MAE never exceeds RMSE
    assert math.isfinite(r.rmse)


def test_forest_scores_cover_the_frame(spark):
    scores = _run(spark, "demand_rf_scores")
    (m,) = _run(spark, "demand_rf_metrics").collect()
    assert scores.count() == m.train_samples + m.test_samples
    assert scores.groupBy("book_id", "sale_date").count().where("count > 1").count() == 0
    assert scores.where(F.col("prediction").isNull() | F.isnan("prediction")).count() == 0


def test_forecast_has_every_book_and_day(spark, models):
    fc = _run(spark, "demand_forecast")
    books = models.dim_books.count()
    assert fc.count() == books * 7
    per = fc.groupBy("book_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"),
                                    F.countDistinct("day").alias("n")).collect()
    assert len(per) == books and all((r.lo, r.hi, r.n) == (1, 7, 7) for r in per)
    assert fc.where(F.col("predicted_demand").isNull()).count() == 0


def test_feature_importance_is_a_distribution(spark):
    rows = _run(spark, "feature_importance").collect()
    assert len(rows) == len({r.feature for r in rows})
    assert all(r.importance >= 0 for r in rows)
    assert abs(sum(r.importance for r in rows) - 1.0) < 1e-9


# ---------------------------------------------------------------------------
# ALS and hybrid recommendations
# ---------------------------------------------------------------------------


@pytest.mark.parametrize("key", ["als_recommendations", "hybrid_recommendations"])
def test_recommendation_lists(spark, key):
    rows = _run(spark, key).collect()
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r)
    assert by_user
    for recs in by_user.values():
        recs.sort(key=lambda r: r.rank)
        assert [r.rank for r in recs] == list(range(1, len(recs) + 1))
        assert len(recs) <= 10
        assert len({r.book_id for r in recs}) == len(recs)
        scores = [r.score for r in recs]
        assert scores == sorted(scores, reverse=True)


def test_hybrid_score_is_bounded_by_its_parts(spark):
    # 0.6 * content + 0.4 * collaborative, each part at most 1 after scaling.
    rows = _run(spark, "hybrid_recommendations").collect()
    assert all(-1e-12 <= r.score <= 1.0 + 1e-12 for r in rows)


# ---------------------------------------------------------------------------
# BM25: brute force over every document, written from the published scorer
# ---------------------------------------------------------------------------


def _okapi_topk(queries, docs, k, k1=1.5, b=0.75, eps=0.25):
    import regex
    tok = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    dtoks = {i: tok(t) for i, t in docs}
    n = len(dtoks)
    avgdl = sum(len(v) for v in dtoks.values()) / n
    tfs = {i: Counter(v) for i, v in dtoks.items()}
    df = Counter(w for c in tfs.values() for w in c)
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: (floor if v < 0 else v) for w, v in idf.items()}
    out = {}
    for qid, text in queries:
        qt = tok(text)
        scores = {}
        for i, c in tfs.items():
            if not any(w in c for w in qt):
                continue
            dl = len(dtoks[i])
            scores[i] = sum(idf.get(w, 0.0) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * dl / avgdl))
                            for w in qt if w in c)
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out[qid] = ranked
    return out


def test_bm25_equals_brute_force_on_whole_tables(spark):
    from inkwell.operators.retrieval import bm25_topk
    q = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {}
    for r in bm25_topk(q, d, k=5).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.bm25_score))
    want = _okapi_topk([(r.item_id, r.text) for r in q.collect()],
                       [(r.doc_id, r.text) for r in d.collect()], 5)
    assert set(got) == {k for k, v in want.items() if v}
    for qid, ranked in want.items():
        mine = sorted(got.get(qid, []))
        assert [x[1] for x in mine] == [i for i, _ in ranked]
        assert all(math.isclose(x[2], s, rel_tol=1e-9) for x, (_, s) in zip(mine, ranked))


def test_bm25_pruning_keeps_exact_top_k_under_frequent_terms(spark):
    # Frequent terms in every document (low idf) and one rare term: the
    # floor makes the frequent terms non-essential, the answer stays exact.
    from inkwell.operators.retrieval import bm25_topk
    common = "alpha beta gamma delta "
    docs = [(i, common * (1 + i % 3) + ("rare" if i % 17 == 0 else "") + f" w{i}") for i in range(200)]
    queries = [(1, "alpha beta rare"), (2, "gamma delta w5 w7"), (3, "nothing here"), (4, "alpha alpha")]
    dq = spark.createDataFrame(queries, "item_id long, text string")
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in bm25_topk(dq, dd, k=3).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id))
    want = _okapi_topk(queries, docs, 3)
    for qid, ranked in want.items():
        assert [i for _, i in sorted(got.get(qid, []))] == [i for i, _ in ranked]


# ---------------------------------------------------------------------------
# Seeded generators
# ---------------------------------------------------------------------------


def test_generators_are_seeded_and_sized(spark):
    from inkwell.sources.generate import GenerationConfig, generate_all
    from inkwell.sources.schemas import RAW_SCHEMAS
    cfg = GenerationConfig(n_publishers=20, n_books=100, n_sales=500, n_inventory=50, n_campaigns=40)
    a, b = generate_all(spark, cfg), generate_all(spark, cfg)
    sizes = {"publishers": 20, "books": 100, "sales": 500, "inventory": 50, "campaign_events": 40}
    for name, df in a.items():
        assert [f.name for f in df.schema] == [f.name for f in RAW_SCHEMAS[name]]
        assert df.count() == sizes[name]
        assert df.exceptAll(b[name]).count() == 0  # same seed, same rows
    assert a["books"].join(a["publishers"], "publisher_id", "left_anti").count() == 0
    assert a["sales"].join(a["books"], "book_id", "left_anti").count() == 0
    other = generate_all(spark, GenerationConfig(n_publishers=20, n_books=100, n_sales=500,
                                                 n_inventory=50, n_campaigns=40, seed=7))
    assert other["sales"].exceptAll(a["sales"]).count() > 0


# ---------------------------------------------------------------------------
# Incremental upsert
# ---------------------------------------------------------------------------


def _facts(spark, rows):
    import datetime as dt
    schema = "transaction_id string, quantity int, sale_year int, sale_month int, dbt_updated_at timestamp_ntz"
    return spark.createDataFrame([(t, q, y, m, dt.datetime(*load)) for t, q, y, m, load in rows], schema)


def test_upsert_replaces_by_key_and_rejects_schema_change(spark):
    from inkwell.operators.incremental import upsert
    from inkwell.sources.schemas import SchemaChangeError
    t0, t1 = (2001, 1, 1), (2001, 2, 1)
    target = _facts(spark, [("a", 1, 2000, 1, t0), ("b", 2, 2000, 2, t0)])
    # "late" was sold before the target's rows and is loaded after them.
    batch = _facts(spark, [("b", 5, 2000, 2, t1), ("c", 3, 2000, 3, t1), ("late", 4, 1999, 1, t1)])
    merged = {r.transaction_id: r.quantity for r in upsert(target, batch).collect()}
    assert merged == {"a": 1, "b": 5, "c": 3, "late": 4}
    stale = _facts(spark, [("a", 9, 2000, 1, t0)])  # not loaded after the mark
    assert {r.transaction_id: r.quantity for r in upsert(target, stale).collect()} == {"a": 1, "b": 2}
    with pytest.raises(SchemaChangeError):
        upsert(target, batch.withColumn("extra", F.lit(1)))


def test_partitioned_upsert_prunes_and_rewrites_only_touched_months(spark, tmp_path):
    from inkwell.operators import incremental as inc
    path = str(tmp_path / "facts")
    t0, t1 = (2001, 1, 1), (2001, 2, 1)
    inc.write_upsert(spark, path, _facts(spark, [(f"{m}-{i}", i, 2000, m, t0) for m in range(1, 7) for i in range(3)]))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")}
    batch = _facts(spark, [("2-1", 9, 2000, 2, t1), ("5-x", 7, 2000, 5, t1)])
    out = inc.write_upsert(spark, path, batch)
    rows = {r.transaction_id: r.quantity for r in out.collect()}
    assert len(rows) == 19 and rows["2-1"] == 9 and rows["5-x"] == 7 and rows["2-0"] == 0
    kept = {p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert {p.parent.name for p in kept} == {f"sale_month={m}" for m in (1, 3, 4, 6)}
    plan = inc.touched_partitions(out, batch, inc.PARTITION_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("PartitionFilters: ")[1:])
    assert "2000" in scan.split("PushedFilters")[0]
    assert inc.read_table(spark, str(tmp_path / "nothing")) is None
    assert inc.write_upsert(spark, path, batch.limit(0)).count() == 19


def test_streams_in_several_micro_batches(spark, tmp_path):
    """Arrivals taken one file at a time give the table of one batch."""
    import datetime as dt
    from inkwell.streaming import loaders as L
    rows = [(i, dt.datetime(2024, 1, 1 + i // 8, i % 24), i % 3, ("view", "click")[i % 2], 0.0, "") for i in range(64)]
    rows.append((99, None, 1, "view", 0.0, ""))
    events = spark.createDataFrame(rows, L.EVENT_SCHEMA)
    landing = L.land_in_time_order(events.coalesce(1), "ts", str(tmp_path / "in"))
    assert spark.read.parquet(landing).count() == 65  # a row without a time lands, too
    out = L.campaign_window_stream(spark, landing, str(tmp_path / "out"), str(tmp_path / "ck"), files_per_batch=1)
    want = {}
    for _, ts, user, kind, _, _ in rows[:-1]:
        key = (user, ts.date())
        want.setdefault(key, [0, 0])[kind == "click"] += 1
    assert {(r.user_id, r.window_date): [r.impressions, r.clicks] for r in out.collect()} == want


# ---------------------------------------------------------------------------
# Keys, hybrid blend, forecasts, metrics, several blocks
# ---------------------------------------------------------------------------


def test_dense_ids(spark):
    from inkwell.operators.keys import dense_ids
    keys = [2 ** 40 + 7 * (i % 500) for i in range(2000)] + [None]
    got = dense_ids(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "n").collect()
    assert {r.k: r.n for r in got} == {k: i for i, k in enumerate(sorted({k for k in keys if k}))}


def test_als_takes_large_ids(spark):
    from inkwell.operators.extras import als_scores
    base = 2 ** 33
    rows = [(u, base + b, float(1 + (u_ + b) % 3)) for u_, u in enumerate("xyz") for b in range(12) if (b + u_) % 4]
    out = als_scores(spark.createDataFrame(rows, "user_id string, book_id long, rating double"), rank=4).collect()
    owned = {(u, b) for u, b, _ in rows}
    assert {(r.user_id, r.book_id) for r in out} == {
        (u, base + b) for u in "xyz" for b in range(12)} - owned


def test_hybrid_blends_whole_score_tables(spark):
    import random
    from inkwell.operators.extras import hybrid_recommendations
    rng = random.Random(3)
    sides = [{(u, b): rng.random() for u in "ab" for b in range(200) if rng.random() < 0.7} for _ in range(2)]
    frames = [spark.createDataFrame([(u, b, s) for (u, b), s in side.items()],
                                    "user_id string, book_id long, score double") for side in sides]
    got = {(r.user_id, r["rank"]): r.book_id for r in hybrid_recommendations(*frames, n=10).collect()}
    for u in "ab":
        blend = {}
        for side, weight in zip(sides, (0.6, 0.4)):
            own = {b: s for (v, b), s in side.items() if v == u}
            lo, hi = min(own.values()), max(own.values())
            for b, s in own.items():
                blend[b] = blend.get(b, 0.0) + weight * (s - lo) / (hi - lo)
        best = sorted(blend, key=lambda b: (-blend[b], b))[:10]
        assert [got[u, k] for k in range(1, 11)] == best


def test_forecast_holds_every_book_and_day(spark, tmp_path):
    from inkwell.operators import forecast as FC
    from inkwell.plans import q_forecast
    from inkwell.plans.models import Models
    m = Models(spark, SF_SMALL)
    model, frame, _, test = q_forecast.trained(m)
    out = FC.demand_forecast(model, frame, m.dim_books, m.daily_demand, 7)
    keys = [(r.book_id, r.day) for r in out.collect()]
    assert len(keys) == len(set(keys)) == 7 * m.dim_books.count()
    cold = m.dim_books.select((F.col("book_id") + 10 ** 9).alias("book_id")).limit(3)
    more = FC.demand_forecast(model, frame, cold, m.daily_demand, 2).where("method = 'default'").collect()
    assert len(more) == 6 and {r.predicted_demand for r in more} == {FC.DEFAULT_DEMAND}
    FC.save_forest(model, str(tmp_path / "model"))
    again = FC.load_forest(str(tmp_path / "model"))
    rows = lambda x: sorted(map(tuple, FC.score(x, test).collect()))
    assert rows(model) == rows(again)
    assert FC.feature_importance(model) == FC.feature_importance(again)


def test_exact_metrics_do_not_overflow(spark):
    from inkwell.operators.metrics import regression_metrics
    df = spark.range(4000).select((F.col("id") * 2_000).alias("label"), (F.col("id") * 2_000 + 1).alias("prediction"))
    got = regression_metrics(df, exact=True).first()
    assert got.mae == 1.0 and got.r2 == pytest.approx(1.0)


def test_several_blocks_equal_one(spark):
    from inkwell.operators import similarity as S, user_items as UI
    from inkwell.plans import q_recommend as QR
    from inkwell.plans.models import Models
    m = Models(spark, SF_SMALL)
    vectors, inter = QR.vectors(m), QR.interactions(m)
    rows = lambda df: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in df.collect())
    assert rows(S.item_similarity_topk(vectors, 10, blocks=3)) == rows(S.item_similarity_topk(vectors, 10, blocks=1))
    want = rows(UI.user_recommendations(vectors, inter, blocks=1))
    for heavy in (0, 10_000, 330):  # all in pieces, all in chunks, both
        assert rows(UI.user_recommendations(vectors, inter, blocks=3, heavy=heavy)) == want


def test_neighbour_blocks_skip_pairs_and_stay_exact(spark):
    import numpy as np
    from inkwell.operators import similarity as S
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    v = np.repeat(centres, 40, axis=0) + rng.normal(scale=0.02, size=(480, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[5] = 0.0  # a zero vector scores 0 with everything
    v[50] = v[51] = v[52]  # ties
    df = spark.createDataFrame([(i * 7, [float(x) for x in r]) for i, r in enumerate(v)],
                               "book_id long, vec array<double>")
    got = {(r.book_id, r["rank"]): r.other_id for r in S.item_similarity_topk(df, 5, blocks=24).collect()}
    sim = v @ v.T
    for i in range(480):
        want = sorted((-round(sim[i, j], 9), j * 7) for j in range(480) if j != i)[:5]
        assert [got[i * 7, k] for k in range(1, 6)] == [j for _, j in want], i
    assert S.products_formed(df.where("book_id != 35"), 5, 24, 40) < 0.3 * 479 ** 2


def test_tree_search_is_exact_on_any_data(spark):
    """Uniform directions, copies, zero vectors and blocks of one cell."""
    import numpy as np
    from inkwell.operators import similarity as S
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 4))
    v[100:180] = v[100]  # copies that fill a cell of several blocks
    v[200:230] = 0.0
    v = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=np.abs(v).sum(1, keepdims=True) > 0)
    df = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(v)], "book_id long, vec array<double>")
    got = {(r.book_id, r["rank"]): r.other_id for r in S.item_similarity_topk(df, 6, blocks=20).collect()}
    sim = v @ v.T
    for i in range(400):
        want = sorted((-round(sim[i, j], 9), j * 3) for j in range(400) if j != i)[:6]
        assert [got[i * 3, k] for k in range(1, 7)] == [j for _, j in want], i
    assert S.item_similarity_topk(df.limit(1), 6, blocks=20).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace
    from inkwell.session import ensure_checkpoint_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(conf={}, sparkContext=context))


# ---------------------------------------------------------------------------
# Block top-k kernel
# ---------------------------------------------------------------------------


def test_block_topk_kernel_is_exact_under_ties():
    import numpy as np
    from inkwell.operators.similarity import _topk_rows
    rng = np.random.default_rng(7)
    a = rng.normal(size=(300, 6))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    sim = np.round(a @ a.T, 2)  # coarse values: many ties, broken by id
    ids = np.arange(300, dtype=np.int64) * 3
    got = _topk_rows(ids, ids, sim, 7)
    for i in range(300):
        want = sorted((-round(sim[i, j], 9), ids[j]) for j in range(300) if j != i)[:7]
        assert list(got[got.book_id == ids[i]].other_id) == [j for _, j in want]
