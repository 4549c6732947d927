import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_helpers import components_by_hand, lev1, prose, rows
from pyspark.sql import functions as F

from veriframe.llm import exact_dedup as exact
from veriframe.llm import golay
from veriframe.llm.exact_dedup import exact_dedup, grow_directory
from veriframe.llm.line_dedup import _variant_rows, line_dedup, variants
from veriframe.llm.simhash import anchor_rows, fingerprint, keep_one, near_links, simhash_dedup
from veriframe.operators.components import components
from veriframe.scratch import materialize


def by_hand(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", [F.xxhash64, lambda t: F.length(t) % 3, lambda t: F.lit(7)])
def test_exact_dedup_also_with_colliding_keys(docs, odd, key):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for df in (docs, odd):
        assert rows(exact_dedup(df, key=key, capacity=8), *cols) == by_hand(map(tuple, df.select("doc_id", "text").collect()))


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup(empty).isEmpty()


@pytest.mark.parametrize("key", [F.xxhash64, lambda t: F.length(t)])
def test_exact_dedup_of_a_hot_text(spark, monkeypatch, key):
    monkeypatch.setattr(exact, "HOT_ROWS", 500)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    index = materialize(exact.build_index(df, "doc_id", "text", 64, key), "hot-test")
    assert index.filter("bucket is null").count() >= 1000 and index.count() == 3000  # hot rows are owned by no bucket
    got = exact_dedup(df, capacity=64, key=key)
    assert got.filter("group_size = 1000 and keep_id = 2997").count() == 1000 and got.filter("kept").count() == 2001


def test_a_long_text_of_many_copies_is_hot(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_LOAD", 100)
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 50_000)).otherwise(F.col("id").cast("string")).alias("text"))
    index = exact.build_index(df, "doc_id", "text")
    assert index.filter("bucket is null").count() == 20 and exact_dedup(df).filter("group_size = 20 and keep_id = 38").count() == 20


def test_texts_move_once_to_the_owners_of_their_buckets(spark, docs):
    src = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    entries = exact.owned(src, 3, [0, 0, 1, 1, 2, 3, 4, 4], 3)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "direct_shuffle_partition_id(owner" in plan and "Python" not in plan
    rows_ = entries.withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["task"], r["bucket"]) for r in rows_}) == 5 and len({r["task"] for r in rows_}) == 3  # a bucket has one owner
    assert all([0, 0, 1, 1, 2, 3, 4, 4][(r["h"] & (2**64 - 1)) >> 61] == r["bucket"] for r in rows_)


def test_links_of_a_chain_are_numbered(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "cc")], "doc_id long, text string")
    index = exact.build_index(df, "doc_id", "text", key=lambda t: F.length(t))
    assert rows(index, "id", "link", "keep_id", "n") == [(1, 2, 3, 2), (2, 1, 2, 1), (3, 2, 3, 2), (4, 1, 4, 1)]


def test_depth_follows_the_load(spark):
    keys = spark.range(4096).select(F.xxhash64("id").alias("h"), F.lit(1).alias("n"), F.lit(1).alias("load"))
    for capacity, least in ((1 << 13, 1), (256, 16), (8, 512)):
        depth, slots, hot = exact.plan(keys, capacity)
        assert slots[-1] + 1 >= least and len(slots) == 1 << depth and not hot


def test_directory_doubles_only_where_it_must():
    assert grow_directory({}, 5, 4) == (0, [0])
    depth, slots = grow_directory({0: 9, 1: 1, 8: 2}, 5, 4)
    assert depth == 4 and len(slots) == 16 and slots == sorted(slots)
    assert len(set(slots[8:])) == 1  # the upper half never split
    assert slots[0] != slots[1]  # the hot cell stands alone, overfull at the last depth


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randint(1, 400), rng.randint(1, 400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(64)] + [(5, 5), (2000, 2001), (2001, 2000)] + [(3000, k) for k in range(3001, 3200)]
    want = components_by_hand(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


@pytest.mark.parametrize("code", [golay.GOLAY, golay.HAMMING])
def test_codes_are_perfect(code):
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << code.length, 500)
    row, near, excess = code.anchors(words, 2)
    assert (np.bincount(row[excess == 0], minlength=500) == 1).all()
    assert (code.syndrome(near) == 0).all()
    weight = np.array([int(x).bit_count() for x in words[row] ^ near])
    assert (np.maximum(weight - code.radius, 0) == excess).all() and weight.max() == code.radius + 2


@pytest.mark.parametrize("groups", [1, 2, 3])
def test_anchors_cover_all_links(spark, groups):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    near = [int(b) ^ int(np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))).astype(np.int64)) for b in base for _ in range(4)]
    every = sorted({*map(int, base), *near, 0, 1, 3, -1})
    want = {(a, b) for a in every for b in every if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = near_links(spark.createDataFrame([(x,) for x in every], "fp long"), 2, groups).collect()
    assert len(got) == len(want) and {(r["u"], r["v"]) for r in got} == want
    row, _, home = anchor_rows(np.array(every), groups, 2)
    assert (np.bincount(row[home], minlength=len(every)) == 1).all()


def fingerprint_by_hand(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, docs, odd):
    for df in (docs, odd.filter("doc_id is not null")):
        pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
        fps = [fingerprint_by_hand(t) if t is None or len(t) < 100_000 else fingerprint(t) for _, t in pairs]
        links = [(pairs[i][0], pairs[j][0]) for i in range(len(fps)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 2]
        root = components_by_hand([(a, b) for a, b in links if a != b])
        want = sorted(((i, f"{f:016x}", root.get(i, i)) for (i, _), f in zip(pairs, fps)), key=repr)
        assert rows(simhash_dedup(df), "doc_id", "fingerprint", "component_id") == want


def test_shingles_are_sparks_xxhash64(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("été ça"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("été ça".encode(), 42)).astype(np.int64)
    assert fingerprint("Été ÇA où OÙ") == fingerprint_by_hand("Été ÇA où OÙ") and fingerprint("a B") == xxhash.xxh64_intdigest(b"a b", 42) and fingerprint(None) == 0


def test_one_of_each_group_stays(odd, empty):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert ids == sorted((x is None, x or 0) for x in (1, 2, 4, 7, None, 10, 11))  # None: 'alpha beta' has no near partner
    assert keep_one(empty).isEmpty() and simhash_dedup(empty).isEmpty()


def cut_by_hand(pairs, near_chars=5):
    lines = [(i, no, x) for i, t in pairs if t is not None for no, x in enumerate(t.split("\n"))]
    order = sorted(x for x in lines if x[2].strip(" "))
    first, near = {}, set()
    for i, no, x in order:
        if x not in first:
            if len(x) >= near_chars and any(len(y) >= near_chars and lev1(x, y) for y in first):
                near.add(x)
            first[x] = (i, no)
    out = []
    for i, t in pairs:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        ls = t.split("\n")
        kept = [x for no, x in enumerate(ls) if not x.strip(" ") or first[x] == (i, no) and x not in near]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept), sum(first.get(x) == (i, no) and x in near for no, x in enumerate(ls))))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    pool = [prose(rng, rng.randint(2, 9)) for _ in range(60)] + ["aaaaaaaaaaaaaaaaaaaa", "été " * 6, "short", "shirt", "shorts", "four", "fou", "", "   "]

    def edited(x):
        p, kind = rng.randrange(len(x) + 1), rng.randrange(3)
        return x[:p] + ("é" if kind else "") + x[p + (kind != 1) :]

    pairs = []
    for i in range(120):
        ls = [edited(x) if rng.random() < 0.3 else x for x in rng.choices(pool, k=rng.randint(0, 6))]
        pairs.append((i, "\n".join(ls)))
    pairs += [(500, None), (501, ""), (502, "line\n" * 50)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert rows(line_dedup(df), "doc_id", "text", "n_lines", "n_dropped", "n_near") == cut_by_hand(pairs)


def test_templated_lines_are_one_group(spark):
    pairs = [(i, f"record number {i % 10} of the same template") for i in range(200)]
    got = line_dedup(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert got.filter("not emptied").select("doc_id").collect() == [(0,)]


def test_line_dedup_of_odd_rows(odd, empty):
    got = line_dedup(odd, carry=("id", "n", "lang", "emptied", "carried"))
    assert got.count() == odd.count() and got.filter("carried.id = 'clash' and carried.emptied = 'clash'").count() == odd.count()
    by = {r["doc_id"]: r for r in got.filter("doc_id is not null").collect()}
    assert by[2]["text"] is None and by[3]["text"] == "" and not by[3]["emptied"] and by[5]["emptied"] and by[9]["text"] == "  \n\t "
    repeated = got.filter("doc_id = 8").collect()
    assert len(repeated) == 2 and all(r["emptied"] for r in repeated)
    assert line_dedup(empty).isEmpty()


def test_variants_share_a_key_iff_one_edit_apart():
    rng = random.Random(4)

    def keyed(x):
        roles, keys = variants(x, range(4))
        return {(int(r), int(a), int(b)) for r, a, b in zip(roles, *keys)}

    for k in range(600):
        a = "".join(rng.choices("ab", k=rng.randint(4, 9)))
        p, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:p] + ("c" if kind else "") + a[p + (kind != 1) :] if k % 2 else "".join(rng.choices("ab", k=rng.randint(4, 9)))
        met = {((2 if r == 2 else 1 - r), *k) for r, *k in keyed(a)} & keyed(b)  # the shorter meets the longer, equals meet
        assert a == b or bool(met) == lev1(a, b)


def test_variants_of_a_long_line_come_in_bounded_batches():
    line = "".join(random.Random(2).choices("abcdefgh ", k=300_000))
    batch = pa.RecordBatch.from_pydict({"id": [1], "d1": [2], "d2": [3], "no": pa.array([0], pa.int32()), "tags": [[0, 1, 2, 3]], "line": [line]})
    sizes = [b.num_rows for b in _variant_rows([batch])]
    assert sum(sizes) == 600_001 and max(sizes) <= 1 << 17


def test_line_dedup_of_long_lines(spark):
    line = "".join(random.Random(2).choices("abcdefgh ", k=60_000))
    pairs = [(1, line), (2, line[:40_000] + "x" + line[40_000:]), (3, line[:100] + line[101:]), (4, line[:100] + "xy" + line[102:])]
    got = line_dedup(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_near", "emptied") == [(1, 0, False), (2, 1, True), (3, 1, True), (4, 0, False)]


def test_any_type_of_id_and_any_other_column(spark):
    names = ["n_lines", "n_near", "n_dropped", "emptied", "carried", "row", "_row", "ROW", "fp", "text_hash", "d1", "lines", "stay"]
    df = spark.createDataFrame([("b", "one line\nanother line"), ("a", "one line\nthird"), (None, "third"), ("c", None)], "doc_id string, text string")
    for n in names:
        if n.lower() not in [c.lower() for c in df.columns]:
            df = df.withColumn(n, F.lit("clash"))
    assert rows(line_dedup(df, carry=("emptied", "_row")), "doc_id", "text") == sorted([("b", "another line"), ("a", "one line"), (None, "third"), ("c", None)], key=repr)
    kept = keep_one(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert rows(simhash_dedup(df), "doc_id", "component_id") == sorted([(x, x) for x in ("a", "b", "c", None)], key=repr)
    assert exact_dedup(df).count() == 4
