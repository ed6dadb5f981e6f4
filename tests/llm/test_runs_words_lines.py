"""Periodic runs, spelling variants and line de-duplication against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from meterlake.llm import line_dedup, periodic_runs, spelling_variants
from meterlake.llm.registry import planted_repeats
from meterlake.storage import Scratch

DOCS = "doc_id long, text string"


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def plain_collapse(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(r, most):
    n, kinds = r.randint(0, most), r.choice([1, 2, 3, 8, 50])
    words = [r.randrange(kinds) for _ in range(n)]
    if n > 8 and r.random() < 0.7:
        a = r.randrange(n)
        p = 1 + r.randrange(max(1, (n - a) // 3))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 32, 64, 128, 4096, 8192):
        x = rng.integers(0, 2700, (size, 3)).astype(float)
        back = periodic_runs.transform(periodic_runs.transform(x), inverse=True)
        assert ((back - x * size) % periodic_runs.PRIME == 0).all()


@pytest.mark.parametrize("greatest", [4, periodic_runs.GREATEST_BLOCK])
def test_runs_of_many_texts_at_once(monkeypatch, greatest):
    monkeypatch.setattr(periodic_runs, "GREATEST_BLOCK", greatest)
    r = random.Random(greatest)
    for _ in range(120):
        texts = sorted((random_words(r, 130) for _ in range(r.randint(1, 6))), key=lambda t: -len(t))
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = sorted(periodic_runs.runs_of(np.array([w for t in texts for w in t], np.int64), edges))
        assert got == [(int(e) + a, int(e) + a + n, q) for e, t in zip(edges, texts) for a, n, q in plain_runs(t)]


def test_runs_survive_lying_hashes(monkeypatch):
    # Every comparison of hashes says yes: the words themselves must decide.
    monkeypatch.setattr(periodic_runs._Extension, "equal", lambda self, start, end, distance: np.ones(len(start), bool))
    for words in ([0, 1] * 8 + [2, 3, 4] + [5] * 9, [7] * 6, list(range(30))):
        got = sorted(periodic_runs.runs_of(np.array(words), np.array([0, len(words)])))
        assert got == [(a, a + n, q) for a, n, q in plain_runs(words)]


def test_periodic_runs_query_rows(spark):
    r = random.Random(3)
    texts = [" \t".join(f"w{x}" for x in random_words(r, 300)) for _ in range(60)]
    texts += [None, "", " \n ", "a " * 5, "a " * 6, "é " * 3000, "b", "Same same " * 8, "x y " * 7]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "z " * 9)]
    docs = spark.createDataFrame([(*row, i, "r") for i, row in enumerate(rows)], f"{DOCS}, id int, runs string").repartition(5)
    out = {row.id: row for row in periodic_runs.periodic_runs(docs, ["doc_id", "id", "runs"]).collect()}
    assert len(out) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        words = (text or "").encode().split()
        runs = plain_runs(words)
        assert out[i].doc_id == doc_id
        assert [tuple(x) for x in out[i].runs] == runs
        assert out[i].collapsed == plain_collapse([w.decode() for w in words], runs)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS), ["doc_id"]).collect() == []


def test_planted_repeats(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 47))) for i in range(200)] + [(None, "a b c d e f g"), (10, None)]
    got = {(x.doc_id, i): x.text for i, x in enumerate(planted_repeats(spark.createDataFrame(rows, DOCS).coalesce(1)).collect())}
    changed = 0
    for i, (doc_id, text) in enumerate(rows):
        words = (text or "").split()
        h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
        want = text
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(n))
            changed += want != text
        assert got[doc_id, i] == want
    assert changed


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if v != w and plain_near(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], form[w], words.get(form[w]), root, len(near[w]))
    return out


def variants_of(docs, **options):
    return {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in spelling_variants.spelling_variants(docs, **options).collect()}


def test_spelling_variants_against_all_pairs(spark):
    r = random.Random(7)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(120)]
    words = {}
    for stem in stems:
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(stem) + 1)
            word = r.choice([stem, stem[:at] + r.choice("abcÿz") + stem[at:], stem[:at] + stem[at + 1:]])
            words[word] = r.randint(1, 9)
    # A chain of forms: each word is at least half as frequent as the next.
    words |= {"gardn": 3, "garden": 9, "gardens": 20}
    text = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(text)
    rows = [(i, "; ".join(text[i::40])) for i in range(40)] + [(None, None), (5, "")]
    docs = spark.createDataFrame([(*row, "w") for row in rows], f"{DOCS}, word string").repartition(7)
    want = plain_variants({w: n for w, n in words.items() if len(w) >= 5 and n >= 3})
    assert variants_of(docs) == want
    assert any(v[3] not in (w, v[1]) for w, v in want.items())


def test_near_pairs_of_cut_cells(spark):
    # One common half: its cell is dealt into pieces, and every two of them must meet.
    r = random.Random(2)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(2, 4))) + "ation" for _ in range(150)} | {"q" * 400, "q" * 401, "q" * 399 + "r"})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    scratch = Scratch(spark, "test")
    got = {(x.word, x.near) for x in spelling_variants.near_pairs(table, scratch, part_words=16).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and plain_near(a, b)}
    scratch.clear()


def test_words_are_counted_as_stated(spark):
    rows = [(1, "Straße STRASSE strasse strasse, naïve Naïve naïve_naïve ÀPROPOS àpropos Àpropos àpropos àpropos"), (1, "abcd " * 9), (None, "ab3de " * 4), (2, None)]
    got = {r.word: r.n for r in spelling_variants.counted_words(spark.createDataFrame(rows, DOCS)).collect()}
    # Only A-Z are lowered.
    assert got == {"strasse": 3, "naïve": 4, "àpropos": 3}
    many = spark.createDataFrame([(i, "wonder") for i in range(2000)] + [(None, "wonder")], DOCS)
    want = {}
    for i in [*range(2000), ""]:
        h = zlib.crc32(f"{i}:wonder".encode())
        word = "wonder" if h % 97 else "wonder"[: h % 6] + "wonder"[h % 6 + 1:]
        want[word] = want.get(word, 0) + 1
    got = {r.word: r.n for r in spelling_variants.counted_words(many, typos_one_in=97).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    assert spelling_variants.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling_variants.spelling_variants(spark.createDataFrame([(1, None)], DOCS)).collect() == []


def plain_dedup(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})

    docs = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                docs.setdefault(key(line), set()).add(-1 if doc_id is None else doc_id)
    lost = {k: max(ids) for k, ids in docs.items() if len(ids) >= 5}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if lost.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup_against_plain_version(spark, batches):
    r = random.Random(batches)
    common = [f"{'Common LINE' if i % 2 else 'gewöhnliche Zeile'} number {i} of the templates that texts share" for i in range(30)]
    rows = []
    for i in range(300):
        lines = [r.choice(common) for _ in range(r.randint(0, 6))] + [f"own line {i} {j}" * r.randint(1, 4) for j in range(r.randint(0, 4))]
        lines = [r.choice(["", " ", "\t", "\r"]) + r.choice([str, str.upper])(x) + r.choice(["", "  "]) for x in lines]
        r.shuffle(lines)
        rows.append((i * 7 % 301, "\n".join(lines)))
    rows += [(None, common[0]), (None, common[0]), (5, None), (6, ""), (7, "\n\n"), rows[3], (8, "\n".join(["é" * 39, "é" * 40]))]
    rows += [(400 + i, "é" * 40 + "\n" + "é" * 39) for i in range(4)]
    docs = spark.createDataFrame([(*row, "n") for row in rows], f"{DOCS}, n_lines string").repartition(6)
    scratch = Scratch(spark, "test")
    out = line_dedup.drop_repeated_lines(docs, ["doc_id", "n_lines"], scratch, batches=batches)
    got = sorted((tuple(x) for x in out.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)
    want = sorted(plain_dedup(rows), key=repr)
    assert got == want
    assert any(x[2] for x in want)
    scratch.clear()


def test_line_runs_are_levelled_and_merged_without_shuffles(spark):
    scratch = Scratch(spark, "test")
    runs = line_dedup.LineRuns(scratch, 4)
    for batch in range(5):
        rows = [(1000 - 10 * batch - i % 10, i % 37, 0, i % 3) for i in range(200)]
        runs.add(spark.createDataFrame(rows, "doc_id long, line_a long, line_b long, salt int"))
    # Five batches: one run of four and one of the last.
    assert {level: len(names) for level, names in runs.levels.items()} == {0: 1, 2: 1}
    plan = runs.all()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = {(x.line_a, x.salt): (x.documents, x.holder) for x in runs.all().collect()}
    want = {}
    for batch in range(5):
        for i in range(200):
            want.setdefault((i % 37, i % 3), set()).add(1000 - 10 * batch - i % 10)
    assert got == {k: (len(v), max(v)) for k, v in want.items()}
    runs.clear()
    scratch.clear()


def test_line_hash_ignores_place(spark):
    keys = [b"x" * 50, "zß".encode() * 20, b"y" * 41]
    a, b = line_dedup._hashes(keys)
    c, d = line_dedup._hashes(keys[::-1])
    assert a.tolist() == c[::-1].tolist() and b.tolist() == d[::-1].tolist() and len({*a.tolist(), *b.tolist()}) == 6


def test_empty_table_of_lines(spark):
    scratch = Scratch(spark, "test")
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS), ["doc_id"], scratch).collect() == []
    one = line_dedup.drop_repeated_lines(spark.createDataFrame([(None, None)], DOCS), ["doc_id"], scratch).first()
    assert tuple(one) == (None, 1, 0, "") and hashlib.sha256(one.kept_text.encode()).hexdigest().startswith("e3b0")
    scratch.clear()
