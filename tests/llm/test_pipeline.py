import corpus_pipeline
import pytest
from llm_helpers import components_by_hand, rows
from pyspark.sql import functions as F
from test_dedup import cut_by_hand, fingerprint_by_hand
from test_text_operators import contaminated_by_hand

from veriframe.llm import language_id, queries
from veriframe.llm.common import fold
from veriframe.llm.sentencepiece import decode
from veriframe.scratch import materialize


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, fn in corpus_pipeline.STAGES:
        docs = materialize(fn(spark, docs, sf), name)
        out.append(docs)
    return out


def test_each_stage_against_brute_force(spark, sf, docs, stages):
    said, cut, near, clean, coded = stages
    m = language_id.fit(docs, fold(F.col("doc_id"), 5) != 0)
    stay = []
    for r in docs.collect():
        h, n = m.entropies([r["text"]])
        k = h.argmin(axis=1)
        if n[0] and m.standardised(h[0, k], n, k)[0] <= m.limit[k][0]:
            stay.append(r["doc_id"])
    assert sorted(r[0] for r in said.select("doc_id").collect()) == sorted(stay)

    pairs = [tuple(r) for r in said.select("doc_id", "text").collect()]
    want = [(i, t) for i, t, n, gone, _ in cut_by_hand(pairs) if not (gone and not t.replace("\n", " ").strip(" "))]
    assert rows(cut, "doc_id", "text") == sorted(want, key=repr)
    assert cut.filter("n_chars <> length(text)").isEmpty()

    fps = [(i, fingerprint_by_hand(t)) for i, t in want]
    root = components_by_hand([(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 2])
    kept = [(i, t) for i, t in want if root.get(i, i) == i]
    assert rows(near, "doc_id", "text") == sorted(kept, key=repr)

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated_by_hand(kept, items) if r[5]}
    assert rows(clean, "doc_id", "text") == sorted(((i, t) for i, t in kept if i not in bad), key=repr)

    assert rows(decode(coded), "doc_id", "text") == rows(clean, "doc_id", "text")
    assert coded.filter("n_tokens <> size(ids)").isEmpty()


def test_columns_and_run(spark, sf, docs, stages):
    for s in stages[:-1]:
        assert s.columns == docs.columns and s.dtypes == docs.dtypes
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens") == rows(stages[-1], "doc_id", "n_tokens")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]


def test_documents_with_a_passage_of_one_item_are_dropped(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item), (2, "short item"), (3, "other")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {
        1: f"before it {item} and after it", 2: "so Four, five six\nseven eight nine ten ELEVEN it ends", 3: "just two three four five six seven eight, no more",
        4: "a short item alone", 5: "a short item and the other", 6: "nothing of it", 7: "", 8: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert rows(clean, "doc_id", "text") == [(i, texts[i]) for i in (3, 4, 6, 7, 8)]


def test_no_planted_passage_is_left(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    near, clean = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    hit = {r[0] for r in contaminated_by_hand(near.items(), items) if r[2]}
    assert hit and set(clean) == set(near) - hit


def test_odd_and_empty_tables_pass_through(spark, sf, odd, empty):
    for start in (odd, empty):
        docs = start
        for name, fn in corpus_pipeline.STAGES:
            docs = materialize(fn(spark, docs, sf), f"odd-{name}")
        assert set(docs.columns) == {"doc_id", "ids", "n_tokens"}
        assert docs.count() <= start.count()


def test_stages_carry_columns_of_any_name(spark, sf):
    names = ["n_lines", "n_near", "n_dropped", "emptied", "carried", "_row", "row", "fp", "text_hash", "_id", "at", "id", "lines"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = materialize(fn(spark, docs, sf), f"names-{name}")
        assert docs.columns[-len(names) :] == names and docs.filter(" or ".join(f"`{n}` <> '{n}'" for n in names)).isEmpty()
    assert docs.count() > 0


def test_a_query_for_each_operator():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_shared_folder_is_the_sessions(spark, tmp_path):
    from veriframe import scratch as common

    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == "spark.checkpoint.dir" else spark.conf.get(key, default)

    class Session:
        conf, sparkContext, _jvm, _jsc = Conf(), spark.sparkContext, spark._jvm, spark._jsc

    assert common.shared_dir(Session) == str(tmp_path)
    (tmp_path / "veriframe" / "x").mkdir(parents=True)
    common.clear_scratch(Session)
    assert not (tmp_path / "veriframe").exists() and common.shared_dir(spark) == common.shared_dir(spark)
