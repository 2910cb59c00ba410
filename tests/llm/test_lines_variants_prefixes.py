"""Line dedup, spelling variants and the prefix trie against brute force, and on null, empty, long, repeated and clashing rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, lines, prefixes, variants
from tests.llm.test_operators import LOW, ODD

BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def frame(spark):
    """Rows with columns whose names the operators use inside."""
    return lambda docs: spark.createDataFrame([(i, t, "x", 0, 1) for i, t in docs], "doc_id long, text string, key string, n int, _row int").repartition(3)


LINES = [
    (1, "a long first line\nshort\n  A Long FIRST line\t\nonly here, ten"), (2, "a long first line\nshort\nanother line here"), (3, "another line here\r\na long first line"), (3, "another line here"), (None, "a long first line\nits own long line"),
    (None, "its own long line"), (4, None), (5, ""), (6, "\n\n"), (7, "ÄÖÜ äöü long ß"), (8, " äöü ÄÖÜ long ß\nÄÖÜ äöü LONG ß"), (9, "0123456789"), (10, "0123456789\x0b"), (11, "012345678"), (12, "012345678"), (2, "a long first line"),
    (13, "\n".join(f"line number {k}" for k in range(30_000))), (14, "\n".join(f"line number {k}" for k in range(29_999, -1, -2)) + "\nthe end of it all"),
]


def brute_lines(docs, min_docs=2):
    key = lambda line: line.strip(BLANK).translate(LOW)
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        left = [x for x in every if len(held[key(x)]) < min_docs or min(held[key(x)]) == i]
        out.append((i, "\n".join(left), len(every), len(every) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
@pytest.mark.parametrize("sent", [lines.BROADCAST_BYTES, 0])
def test_lines(frame, monkeypatch, min_docs, sent):
    """With all hashes sent to the tasks, and with those alone that stand in more than a tenth of the rows."""
    monkeypatch.setattr(lines, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    out = lines.dedup_lines(frame(LINES), min_docs=min_docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_lines(LINES, min_docs)


def test_lines_of_odd_texts_and_of_none(frame):
    got = lines.dedup_lines(frame(ODD))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(ODD)
    assert lines.digest(lines.dedup_lines(frame(ODD).where("false"))).count() == 0
    sha = {r.doc_id: r.kept_sha256 for r in lines.digest(lines.dedup_lines(frame(LINES))).collect()}
    assert sha[4] == sha[5] == sha[10] == hashlib.sha256(b"").hexdigest()


def test_lines_run_no_python(frame):
    plan = lines.dedup_lines(frame(LINES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


WORDS = "Colours colours COLOURS colours colours colours colours colours colours colours colours colours; colors colors colour colourss naïvetés naïvetès naïvetès abcdefgh abcdefgx abcdefgx"
VARIED = [(1, WORDS), (2, WORDS), (2, WORDS), (None, WORDS), (3, None), (4, ""), (5, "1234 !!"), (6, "aaaaaaaaa aaaaaaaaa aaaaaaaa aaaaaaaa aaaaaaab aaaaaaab baaaaaaa baaaaaaa " * 3), (7, "ÀÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀàÀ ÀÀÀÀÀÀÀàÀ Straßenname straßenname Strassenname Strassenname Ωabcdefgy abcdefgy"), (8, "abcdefgh" * 20_000 + " " + "abcdefgh" * 20_000 + "x " + ("abcdefgh" * 20_000 + " ") * 2), (9, "abcdefgh" * 20_000 + "x")]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = len(os.path.commonprefix([a, b]))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute_variants(docs, misspell=0):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, forms = {}, {}
    for w in words:
        by = [x for x in words if near(w, x)]
        best = min(by, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
        out[w] = (len(by), words[forms[w]] if forms[w] else None)
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, forms[w], root, words[w], *out[w])
    return out


@pytest.mark.parametrize("misspell", [0, 2, 31])
def test_variants(frame, misspell):
    got = variants.group_variants(variants.count_words(frame(VARIED), misspell=misspell))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r) for r in got.collect()} == brute_variants(VARIED, misspell)


def test_variants_follow_forms_to_the_end(spark):
    chain = [("abcdefg" + "x" * k, 10**k) for k in range(9)]
    got = variants.group_variants(spark.createDataFrame([(w, n * 2) for w, n in chain], "word string, n long")).collect()
    assert {r.root for r in got} == {chain[-1][0]} and sum(r.form is None for r in got) == 1


def test_variants_of_odd_texts_and_of_none(frame):
    docs = [(i, t) for i, t in ODD]
    assert {r.word: tuple(r) for r in variants.group_variants(variants.count_words(frame(docs))).collect()} == brute_variants(docs)
    assert variants.group_variants(variants.count_words(frame(docs).where("false"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abà", min_size=1, max_size=6), min_size=1, max_size=12, unique=True))
def test_words_share_a_key_if_they_are_near(words):
    keys, of = variants.keys_of(words)
    own = [set(keys[of == k].tolist()) for k in range(len(words))]
    assert [len(x) for x in own] == [1 + len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words]
    texts = [{w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words]
    for a in range(len(words)):
        for b in range(len(words)):
            assert bool(own[a] & own[b]) == bool(texts[a] & texts[b])
            assert not near(words[a], words[b]) or own[a] & own[b]


TURNS = [
    *((c, t, r, x) for c in (1, 2, 3, 107) for t, r, x in ((0, "system", "you are"), (1, "user", "hello"), (2, "assistant", f"hi {c % 3}"))),
    (4, None, None, None), (4, 0, "user", ""), (4, 0, "user", ""), (5, 3, "user", "b"), (5, 1, "user", "ä😀"), (5, 1, "user", "a"), (None, 0, "user", "of no conversation"), (100, 0, "system", "you are"), (100, 1, "user", "hello"), (100, 2, "user", "more"),
    *((200, t, "user", f"turn {t}") for t in range(300)), *((c, t, "user", f"turn {t}") for c in range(201, 260) for t in range(c - 200)), (6, 0, "user", "long " * 50_000), (300, 0, None, "x"), (301, 0, "", "x"), (302, 0, "a", "bc"), (303, 0, "ab", "c"),
]


def brute_trie(turns, rebuild=True):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, len(x or ""), hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    own = {c: [y[4:] for y in sorted(rows)] for c, rows in own.items()}
    paths = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + rows[h:]) if rebuild else tuple(rows)
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(c for c in m if len(paths[c]) == len(p))) for p, m in nodes.items()), key=repr)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, symbol string, depth int").repartition(5)


@pytest.mark.parametrize(("task", "run"), [(prefixes.TASK, prefixes.RUN), (20_000, 2_000), (3_000, 600)])
def test_trie(talks, monkeypatch, task, run):
    """In one range a core and one run a task, and in many of both, whose open paths are merged in several rounds."""
    for name, value in (("TASK", task), ("RUN", run), ("PIECE", 7 if run < 1000 else 1 << 16)):
        monkeypatch.setattr(prefixes, name, value)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    got = prefixes.digest(*prefixes.prefix_trie(prefixes.rebuilt(prefixes.paths(talks))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(TURNS)


def test_trie_of_conversations_as_they_are(talks):
    nodes, members = prefixes.prefix_trie(prefixes.paths(talks))
    assert sorted((tuple(r) for r in prefixes.digest(nodes, members).collect()), key=repr) == brute_trie(TURNS, rebuild=False)
    said = prefixes.with_texts(nodes, talks).where("conv_id = 5").orderBy("depth").select("role", "text").collect()
    assert [tuple(r) for r in said] == [("user", "a"), ("user", "ä😀"), ("user", "b")]
    assert prefixes.digest(*prefixes.prefix_trie(prefixes.paths(talks.where("false")))).count() == 0


@pytest.mark.parametrize("h", ["in whole", "in pieces"])
def test_trie_of_a_copied_conversation(spark, monkeypatch, h):
    """A conversation that most others equal: one row of the sort, and a list of ids that no task holds as a whole."""
    monkeypatch.setattr(prefixes, "PIECE", 1 << 16 if h == "in whole" else 50)
    turns = [(c, t, "user", f"turn {t}" if c % 10 else f"turn {t} of {c}") for c in range(400) for t in range(4)]
    got = prefixes.digest(*prefixes.prefix_trie(prefixes.paths(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(turns, rebuild=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=8), max_size=7))
def test_runs_merge_in_order_with_what_neighbours_share(runs):
    coded = [[(b"".join(bytes([x]) * prefixes.SYMBOL for x in seq), [k]) for k, seq in enumerate(run)] for run in runs]
    got = [tuple(row[:2]) for row in prefixes.Merge([prefixes.run_of(list(run)) for run in coded])]
    want = sorted(seq for run in coded for seq, _ in run)
    assert [seq for _, seq in got] == want
    assert [n for n, _ in got[1:]] == [prefixes.shared(a, b, 0) for a, b in zip(want, want[1:], strict=False)]


def test_queries_give_every_document_and_node(spark, sf):
    from tessera.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert queries.op11_line_dedup(spark, sf).count() == docs.count()
    nodes = queries.op13_prefix_trie(spark, sf)
    root = nodes.where("depth = 0").first()
    assert root.n_convs == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() and root.n_leaves == nodes.where("n_children = 0").agg(F.count(F.lit(1))).first()[0]
