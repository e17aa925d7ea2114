import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from checks import TABLES, same
from conftest import SMALL
from fixtures import WORDS, empty, frame, odd, rows
from pyspark.sql import functions as F

from factloom import llm
from factloom.llm import components, exact_dedup, hashing, line_dedup, mixing, near_dedup, shared

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(llm.QUERIES[name](spark, SMALL), llm.ORACLES[name], SMALL) == 200


def test_exact_groups_of_odd_rows(spark):
    found = exact_dedup.exact_groups(odd(spark)).collect()
    assert len(found) == 12
    by = defaultdict(list)
    for r in found:
        by[r.text_sha256].append(r)
    same_text = by[hashlib.sha256(b"same text").hexdigest()]
    assert {(r.keep_id, r.group_size) for r in same_text} == {(6, 3)} and [r.doc_id for r in same_text if r.kept] == [6]
    nothing = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in nothing} == {3} and len(nothing) == 3
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_heavy_digests_are_settled_without_a_shuffle_and_alike(spark):
    texts = ["hot"] * 300 + ["warm"] * 40 + [f"t{i}" for i in range(60)]
    docs = frame(spark, rows(*texts))
    assert exact_dedup.frequent_digests(docs.selectExpr("doc_id", "unhex(sha2(text, 256)) AS digest", "doc_id AS nth").selectExpr("*", "xxhash64(digest) AS item"), track=16, heavy=4).count() >= 1
    few, many = (sorted(map(tuple, exact_dedup.exact_groups(docs, track=t, heavy=h).collect())) for t, h in ((16, 4), (1000, 100)))
    clashing = docs.selectExpr("*", "1 AS _sha", "2 AS _keep", "3 AS digest", "4 AS nth", "5 AS keep", "6 AS slice", "7 AS skey", "8 AS taken", "9 AS target", "10 AS _text", "11 AS source_size")
    assert exact_dedup.drop_copies(clashing).columns == clashing.columns == mixing.mixed_documents(clashing).columns
    assert {(r._text, r.size, r.h, r.nth) for r in mixing.mixed_documents(clashing).collect()} == {(10, 9, 7, 4)}
    assert few == many and exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(docs).count() == 62


def _brute_lines(docs):
    lines = {i: (t or "").split("\n") for i, t in docs}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    return {i: (len(ls), "\n".join(x for x in ls if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)])))) for i, ls in lines.items()}


def test_line_dedup_equals_brute_force(spark):
    random.seed(3)
    pool = [f"{'  ' if i % 3 else ''}A shared line of enough length {i % 12}" for i in range(30)] + ["short", "", "é" * 20]
    docs = [(i, "\n".join(random.choice(pool) for _ in range(random.randrange(9)))) for i in range(1, 80)]
    want = _brute_lines(docs)
    for batches, fanout in ((1, 2), (7, 3)):
        got = line_dedup.without_lines(frame(spark, rows(*docs)), batches=batches, fanout=fanout)
        assert {r.doc_id: (r.n_lines, r.text) for r in got.collect()} == want


def test_line_dedup_of_lines_at_form_feeds_and_the_letter_f(spark):
    edged = ["f" + "x" * 18 + "F", "F" * 20, "a shared line with a form feed"]
    around = lambda i: [f"\x0c{x}" if i % 2 else f"{x}\x0c\x0b" for x in edged]
    apart = [f"{'f' * i}one key is not another{'F' * i}" for i in range(4)]
    docs = [(i, "\n".join([*around(i), apart[i - 1]])) for i in range(1, 5)]
    got = {r.doc_id: (r.n_lines, r.text) for r in line_dedup.without_lines(frame(spark, rows(*docs))).collect()}
    assert got == _brute_lines(docs)
    assert got[1] == (4, apart[0]) and got[4] == (4, docs[3][1])


def test_line_dedup_of_odd_rows(spark):
    got = line_dedup.without_lines(odd(spark))
    assert got.count() == 12 and {r.n_lines for r in got.where("doc_id = 2 OR doc_id = 3").collect()} == {1}
    assert line_dedup.without_lines(empty(spark)).count() == 0
    clashing = odd(spark).selectExpr("*", "1 AS _id", "2 AS _gone", "3 AS _h", "4 AS _lines", "5 AS gone", "6 AS th", "7 AS last_doc")
    assert line_dedup.without_lines(clashing).columns == [*clashing.columns, "n_lines", "n_dropped"]
    assert {tuple(r) for r in line_dedup.without_lines(clashing).select("_id", "_gone", "_h", "_lines", "gone", "th", "last_doc").collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.without_lines(odd(spark).withColumn("N_lines", F.lit(1)))


def test_line_dedup_counts_documents_not_rows(spark, tmp_path):
    line = "A line that is long enough {}"
    docs = [(1, line.format(1)), (1, line.format(1)), (2, line.format(1)), (3, line.format(2)), (3, line.format(2) + "\nmore"), (4, line.format(2)), (None, line.format(2)), (None, line.format(3)), (None, line.format(3)), (5, line.format(3)), (None, None)]
    folder = str(tmp_path)
    frame(spark, rows(*docs)).coalesce(1).write.parquet(folder + "/documents")
    (part,) = (tmp_path / "documents").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    assert same(llm.QUERIES["op5_line_dedup"](spark, folder), llm.ORACLES["op5_line_dedup"], folder) == 11
    dropped = Counter((r.doc_id, r.n_dropped) for r in llm.QUERIES["op5_line_dedup"](spark, folder).collect())
    assert dropped == {(1, 0): 2, (2, 0): 1, (3, 1): 2, (4, 0): 1, (None, 1): 1, (None, 0): 3, (5, 0): 1}


def test_new_lines_over_batches(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    texts = [["a line that is long enough\nb line that is long enough"], ["b line that is long enough\nc line that is long enough"], ["c line that is long enough"], ["d line that is long enough"]]
    counts = [line_dedup.fresh_lines(runs, frame(spark, rows(*t, start=10 * i))).count() for i, t in enumerate(texts)]
    assert counts == [2, 1, 0, 1] and [len(level) for level in runs.levels] == [0, 0, 1] and [r.count() for r in runs.runs()] == [4]
    runs.clear()


def test_mix_of_odd_rows_and_budgets(spark):
    found = mixing.mix(odd(spark)).collect()
    assert len(found) == 12 and all(0 <= r.taken <= 2 * r.size for r in found)
    per = defaultdict(lambda: [0, 0.0])
    for r in found:
        per[r.source][0] += r.taken
        per[r.source][1] = r.target
    assert all(taken == int(target) for taken, target in per.values())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    few, many = (sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mix(odd(spark), digits=d).collect()) for d in (1, 4))
    assert few == many


def test_mixed_documents_hold_the_words_taken(spark):
    random.seed(5)
    docs = frame(spark, rows(*[f" {' '.join(random.choices(WORDS, k=random.randrange(1, 40)))}\t\n" for _ in range(90)]))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    sums, texts = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        sums[r.doc_id] += words(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert sums == {i: n for i, n in taken.items() if n}


def _brute_components(docs, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return frozenset([tuple(w)]) if 0 < len(w) < words else frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))

    sets, up = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_copies_equal_brute_force(spark, words, percent):
    random.seed(words)
    docs, at = [], 1
    for _ in range(12):
        base = random.choices([w + str(i) for w in WORDS for i in range(9)], k=random.randrange(40, 160))
        for _ in range(random.choice((1, 2, 14))):
            copy = list(base)
            for _ in range(random.randrange(6)):
                copy[random.randrange(len(copy))] = f"edit{at}"
            docs.append((at, " ".join(copy)))
            at += 1
    docs += [(at, "two words"), (at + 1, "TWO  words"), (at + 2, ""), (at + 3, None)]
    got = near_dedup.linked_components(frame(spark, rows(*docs)), words=words, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _brute_components(docs, words, percent)


def test_near_dedup_of_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.linked_components(odd(spark), words=3, percent=85).collect()}
    assert (6, 1, 5, False) in got and (2, 0, 2, True) in got and any(g[0] is None and g[2] is None for g in got)
    assert near_dedup.linked_components(empty(spark)).count() == 0
    assert near_dedup.drop_near_copies(odd(spark)).columns == odd(spark).columns


def test_rows_that_share_a_doc_id_are_one_node(spark):
    a, b = ([f"{x}{i}" for i in range(40)] for x in "ab")
    near_a, near_b = " ".join(["other", *a[1:]]), " ".join([*b, "other"])
    docs = [(5, " ".join(a)), (5, " ".join(b)), (7, near_b), (3, near_a), (5, ""), (9, "apart " * 9), (9, None), (3, near_a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.linked_components(frame(spark, rows(*docs)), words=3, percent=85).collect())
    assert got == [(3, 38, 3, True), (3, 38, 3, True), (5, 0, 3, False), (5, 38, 3, False), (5, 38, 3, False), (7, 39, 3, False), (9, 0, 9, True), (9, 1, 9, True)]
    clashing = frame(spark, rows(*docs)).selectExpr("*", "1 AS _gone", "2 AS gone", "3 AS id", "4 AS digest")
    assert near_dedup.drop_near_copies(clashing, words=3, percent=85).columns == clashing.columns


def test_query_equals_brute_force_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in shared.table(spark, SMALL, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in llm.QUERIES["op7_near_dedup"](spark, SMALL).collect()}
    assert got == _brute_components(docs, 3, 85)


def test_blocks_compare_whole_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base[:i] + [f"own{i}"] + base[i + 1 :])) for i in range(1, 60)]
    got = near_dedup.linked_components(frame(spark, rows(*docs)), words=3, percent=85)
    assert {r.component_id for r in got.collect()} == {1}


def test_bitmap_bound_never_denies_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (5, 300, 6_000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 10, dtype=np.uint64)])
        marks = []
        for s in (a, b):
            m = np.zeros(near_dedup.BITS, np.uint8)
            m[s % np.uint64(near_dedup.BITS)] = 1
            marks.append(np.packbits(m).view(np.uint64))
        own = int(np.bitwise_count(marks[0] & ~marks[1]).sum())
        assert own <= len(set(a.tolist()) - set(b.tolist()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "u long, v long")
    assert {(r.node, r.component) for r in components.components(edges).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (101, 100)}


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = "Some words  and\tmore " * 50 + "z" * 300
    want = hashing.word_hashes(text).tolist()
    monkeypatch.setattr(hashing, "BLOCK", 64)
    assert hashing.word_hashes(text.upper()).tolist() == want and len(want) == 201
