import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import p1_unify as p1
from quillmere.llm import p2_neighbours as p2


def test_what_looks_the_same():
    same = [("ＡＢ１", "AB1"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("ﬁn", "fin"), ("Соr", "Cor"), ("⽤⼈", "用人"), ("｡､｢｣", "。、「」"), ("が", "が"), ("한", "한"), ("ό", "ó"), ("a b", "a\nb"), ("x \n", "x\n"), ("⻅", "见")]
    other = [("²", "2"), ("①", "1"), ("氣", "气"), ("己", "已"), ("٣", "3"), ("A", "a"), ("草", "革")]
    for a, b in same:
        assert p1.look_of(a) == p1.look_of(b), (a, b)
    for a, b in other:
        assert p1.look_of(a) != p1.look_of(b), (a, b)
    assert p1.form_of("Straße") == p1.form_of("STRASSE")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_stable(text):
    text = text.encode("utf-8", "ignore").decode()
    look = p1.look_of(text)
    assert p1.look_of(look) == look
    assert unicodedata.is_normalized("NFC", p1.form_of(look))


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("t", None, "x"), ("t", "n", None), ("t", "e1", ""), ("t", "e2", "​"), ("u", "z", "黄芪")]
    for k in range(60):
        base = rng.choice(["黄芪 12", "甘草", "fin", "Cor"])
        rows.append(("t", f"k{k % 50}", "".join(rng.choice([c, c, c + "​", unicodedata.normalize("NFD", c), chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c]) for c in base)))
    df = spark.createDataFrame(rows, "record_table string, key string, text string").withColumn("form", F.lit(1)).repartition(5)
    got = sorted((r["record_table"], r["key_a"], r["key_b"]) for r in p1.same_look_pairs(df).collect())
    want = {(ta, min(a, b), max(a, b)) for ta, a, x in rows for tb, b, y in rows if ta == tb and a and b and a != b and x and y and x != y and p1.look_of(x).strip() and p1.look_of(x) == p1.look_of(y)}
    assert got == sorted(want) and len(got) == len(set(got))
    assert p1.same_look_pairs(df.limit(0)).count() == 0


def test_classes_and_records_in_parts(spark, monkeypatch):
    monkeypatch.setattr(p1, "PART", 3)
    rows = [("t", f"a{k}", "黄芪 A") for k in range(10)] + [("t", f"b{k}", "黄芪 A") for k in range(8)] + [("t", "c", "黄芪 a"), ("t", "a0", "黄芪 A"), ("t", "d", " "), ("u", "a0", "黄芪 A")]
    df = spark.createDataFrame(rows, "record_table string, key string, text string").repartition(4)
    pairs = {(r["key_a"], r["key_b"]) for r in p1.same_look_pairs(df).collect()}
    assert pairs == {(f"a{i}", f"b{k}") for i in range(10) for k in range(8)}
    found = p1.classes(df).collect()
    assert sorted((r["record_table"], r["key"], r["variants"], r["links"]) for r in found) == sorted([("t", f"a{k}", 2, 8) for k in range(10)] + [("t", f"b{k}", 2, 10) for k in range(8)] + [("t", "c", 1, 0), ("u", "a0", 1, 0)])
    assert len({r["class_id"] for r in found if r["record_table"] == "t"}) == 1 and len({r["look_id"] for r in found}) == 2
    assert p1.classes(df.limit(0)).count() == 0


def test_look_alikes_are_those_of_the_public_table(spark):
    """Each pair must be confusable by the skeletons of Unicode's table, as far as the JVM carries it."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker
    try:
        skeleton = checker.Builder().build().getSkeleton
        skeleton("a")
    except Exception:
        return
    wrong = {chr(a): b for a, b in p1.LOOKALIKE.items() if b.isascii() and skeleton(chr(a)) != skeleton(b)}
    # One letter is drawn alike but isn't in that table.
    assert set(wrong) <= {"\u051a"}


def test_unify_keeps_rows(spark):
    df = spark.createDataFrame([(1, "ＡＢ"), (2, None), (3, "")], "id int, text string")
    assert [r["form"] for r in p1.unify(df).orderBy("id").collect()] == ["ab", None, ""]


def brute(rows, k=5):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen.setdefault(i, np.asarray(np.float32(v), np.float64))
    ids = sorted(seen)
    x = np.stack([seen[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 10)
    return {(i, ids[j]) for a, i in enumerate(ids) for j in sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(f"m{k:04d}", [float(v) for v in np.float32(centres[k % 12] + rng.normal(size=16) * 0.4)]) for k in range(900)]
    rows += [(f"c{k:02d}", rows[0][1]) for k in range(20)] + [rows[5], rows[6]]
    rows += [("x1", None), ("x2", [0.0] * 16), ("x3", [1.0] * 15), ("x4", [float("nan")] + [1.0] * 15), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("rank", F.lit(9)).repartition(4)
    want = brute(rows)
    # One cell; cells larger than a block; a tree of several levels.
    for more in ({"cell_rows": 2000}, {"cell_rows": 120, "block": 50}, {"cell_rows": 20, "fanout": 4}):
        s = p2.Settings(dim=16, **more)
        got = {(r["id"], r["neighbour"]) for r in p2.neighbours(df, s=s).collect()}
        assert len(got & want) >= 0.97 * len(want)
    assert {r["rank"] for r in p2.neighbours(df, s=s).collect()} == {1, 2, 3, 4, 5}
    assert p2.neighbours(df.limit(0), s=s).count() == 0
    two = spark.createDataFrame(rows[:2], "id string, embedding array<float>")
    assert p2.pairs(p2.neighbours(two, s=s)).count() == 1


def test_neighbours_without_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(f"m{k:04d}", [float(v) for v in np.float32(rng.normal(size=16))]) for k in range(600)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(4)
    want = brute(rows)
    # Vectors without groups in 60 cells: a vector's own cell holds few of its neighbours.
    s = p2.Settings(dim=16, cell_rows=10)
    got = {(r["id"], r["neighbour"]) for r in p2.neighbours(df, s=s).collect()}
    assert len(got & want) >= 0.97 * len(want)


def test_few_vectors_are_verified():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 128))
    x = np.repeat(centres, 20, axis=0) + rng.normal(size=(2000, 128)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = p2.Settings()
    tally = {}
    found = p2.collide_and_verify(x, x[:400], s, p2.lines_for(s), None, tally)
    cosines = x[:400] @ x.T
    best = np.argsort(-cosines, axis=1)[:, :6]
    assert np.mean([len(set(f) & set(b)) / 6 for f, b in zip(found, best, strict=True)]) >= 0.97
    # Only what passed the threshold got a cosine: a few per cent, mostly of the query's own group.
    assert tally["pairs"] == 400 * 2000 and tally["verified"] < 0.05 * tally["pairs"]
    # With a floor only what reaches it is looked for.
    floor = np.full(400, 0.9)
    some = p2.collide_and_verify(x, x[:400], s, p2.lines_for(s), floor, {})
    assert all((cosines[k, f] >= 0.9 - 1e-6).all() for k, f in enumerate(some))


def test_cells_hold_what_they_may_hold():
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, centres = unit(rng.normal(size=(300, 16))), unit(rng.normal(size=(40, 16))).astype(np.float32)
    own, kth = rng.integers(0, 40, 300), rng.uniform(-0.2, 0.95, 300)
    inner = rng.uniform(0, 1, 40)
    outer = inner + rng.uniform(0, 1.5, 40)
    inner[3] = outer[3] = np.inf
    for leaning in (0.0, 0.4, 1.0):
        got = p2.open_cells(x, own, kth, centres, inner, outer, leaning)
        close = x @ centres.T.astype(float)
        t = np.linspace(0, 1, 2001)[:, None, None]
        angle = np.where(np.isfinite(inner), inner, 0) * (1 - t) + np.where(np.isfinite(outer), outer, 0) * t
        most = (np.cos(angle) * close + leaning * np.sin(angle) * np.sqrt(1 - close**2)).max(axis=0)
        want = most >= kth[:, None]
        want[:, 3] = want[np.arange(300), own] = False
        assert not (want & ~got).any() and (got & ~want).sum() <= 12


def test_no_cell_within_reach_is_left_out():
    rng = np.random.default_rng(13)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(np.repeat(unit(rng.normal(size=(60, 12))), 25, axis=0) + rng.normal(size=(1500, 12)) * 0.06)
    tree = p2.Tree()
    tree.split(0, x[rng.choice(1500, 7, replace=False)].astype(np.float32))
    for node in (1, 3, 4):
        tree.split(node, x[rng.choice(1500, 9, replace=False)].astype(np.float32))
    tree.split(10, x[:3].astype(np.float32))
    numbers, centres = tree.leaves()
    place_of = np.full(tree.nodes, -1)
    place_of[numbers] = np.arange(len(numbers))
    cell, cosine = place_of[tree.cell_of(x)], x @ x.T
    for kth in (np.sort(cosine, axis=1)[:, -6], np.sort(cosine, axis=1)[:, -40], np.full(1500, -2.0)):
        may = tree.within_reach(x, kth, place_of, len(numbers))
        q, v = np.nonzero(cosine >= kth[:, None])
        assert may[q, cell[v]].all() and may.all() == (kth[0] < -1)


def test_memory_does_not_grow_with_cells():
    import tracemalloc

    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, centres = unit(rng.normal(size=(512, 8))), unit(rng.normal(size=(20000, 8))).astype(np.float32)
    own, kth, inner = rng.integers(0, 20000, 512), rng.uniform(0.9, 0.99, 512), rng.uniform(0, 0.5, 20000)
    kth[:3] = -2.0
    cell = (x.astype(np.float32) @ centres.T).argmax(axis=1)
    tracemalloc.start()
    leaning = p2.lean(x, cell, centres, p2.Settings(dim=8))
    # All cells for all rows at once are 41 MB in single precision alone.
    assert 0 <= leaning <= 1 and tracemalloc.get_traced_memory()[1] < 15e6
    tracemalloc.reset_peak()
    got, parts = np.zeros(512, np.int64), []
    for q, c in p2.opened(x, own, kth, centres, inner, inner + 0.5, 0.3):
        assert len(q) <= 8192
        np.add.at(got, q, 1)
        parts.append(q[:1000] * 20000 + c[:1000])
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    want = p2.open_cells(x, own, kth, centres, inner, inner + 0.5, 0.3)
    assert got.tolist() == want.sum(axis=1).tolist() and got[0] == 19999 and want.ravel()[np.concatenate(parts)].all()
    assert len(np.unique(np.concatenate(parts))) == sum(map(len, parts))


def test_many_verified_vectors_cost_less_than_one_by_one():
    import time

    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, tally = p2.Settings(), {}
    begun = time.process_time()
    found = p2.collide_and_verify(x[:256], x, s, p2.lines_for(s), np.full(1200, 0.25), tally)
    between = time.process_time()
    # Without groups nearly all vectors pass; the time of a gathered product for each pair is the measure.
    for k in range(0, 1200, 100):
        q, b = np.divmod(np.arange(100 * 256), 256)
        np.einsum("ij,ij->i", x[k + q], x[b])
    assert tally["verified"] > 0.3 * tally["pairs"] and between - begun < 1.5 * (time.process_time() - between)
    cosines = x @ x[:256].T
    assert np.mean([set(f) == set(np.flatnonzero(c >= max(np.sort(c)[-6], 0.25) - 1e-9)) for f, c in zip(found, cosines, strict=True)]) > 0.97
