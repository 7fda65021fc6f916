"""Work that must not stop short: quotes anywhere, long lists of lines, earlier findings."""

from __future__ import annotations

import random
import time

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_llm_edges import SECRET_ROWS, docs_of, prose
from test_llm_queries import plain_pieces

from corridor.llm import op01_language as o1
from corridor.llm import op05_secrets as o5
from corridor.llm import op08_packing as o8
from corridor.llm import op10_decontamination as o10
from corridor.llm._spark import materialise


def test_quotes_are_found_wherever_they_start():
    """92 verbatim characters of an item, from any place in it, inside other text."""
    rng = random.Random(12)
    items = [(k, prose(120, rng)) for k in range(4)]
    ix = o10.build(items)
    for k, body in items:
        for at in [0, *rng.sample(range(len(body) - 92), 25), len(body) - 92]:
            text = ("9 " * 60 + "#" + body[at : at + 92] + "#" + " 9" * 60).encode()
            got = list(o10.search(ix, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
            assert [g[:2] for g in got] == [(0, k)], (k, at)


def plain_windows(ix, texts):
    """{(document, part): (windows that align, least edits)}: every window against every text, on all diagonals."""
    want = {}
    owner = np.repeat(np.arange(len(ix.sizes)), ix.sizes - ix.length + 1)
    for d, t in enumerate(texts):
        x = o10.fold(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        least = np.zeros(len(ix.text), int)
        for m in np.unique(ix.length):
            rows = np.flatnonzero(ix.length[owner] == m)
            pad = np.full(m, 255, np.uint8)
            text = np.concatenate([pad, x, pad])
            least[rows] = o10.banded(np.array([ix.text[r] for r in rows]), np.broadcast_to(text, (len(rows), len(text))))
        for k in range(len(ix.sizes)):
            mine = least[(owner == k) & (least <= ix.edits[owner])]
            if len(mine):
                want[d, k] = (len(mine), int(mine.min()))
    return want


def found_windows(ix, texts):
    offs = np.cumsum([0, *map(len, texts)])
    return {g[:2]: g[2:] for g in o10.search(ix, np.frombuffer(b"".join(texts), np.uint8), offs)}


def test_windows_are_those_that_align():
    """What is found, how often and how well: every window of every item against every text, cell by cell."""
    rng = random.Random(13)
    items = [(k, prose(n, rng)) for k, n in enumerate((40, 30, 45, 9))]
    ix = o10.build(items)
    texts = []
    for k in (0, 1, 2, 3, 0, 1):
        t = list(items[k][1])
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(len(t))] = rng.choice(["", "z", "zz"])
        at = rng.randint(0, 40)
        texts.append((prose(5, rng) + " " + "".join(t)[at : at + 150] + " " + prose(5, rng)).encode())
    want = plain_windows(ix, texts)
    assert found_windows(ix, texts) == want and len(want) >= 4


def test_repetitive_texts_align_too(monkeypatch):
    """Repeats are looked for once and counted in full; portions within a document lose nothing."""
    rng = random.Random(17)
    noisy = lambda s, n: "".join(rng.choice("xyz") if rng.random() < n else c for c in s)
    items = [(0, "a" * 300), (1, "ab" * 90 + prose(12, rng)), (2, "abc " * 60), (3, noisy("abcde " * 40, 0.02)), (4, "a" * 60), (5, "".join(rng.choice("ab") for _ in range(250)))]
    texts = [("a" * 400), "ba" * 200, noisy("abc " * 120, 0.03), noisy("abcde " * 150, 0.02), "q " + "a" * 250 + " q " + "ab" * 60, "".join(rng.choice("ab") for _ in range(600)), items[5][1][40:220], "a" * 107, "a" * 108, "b" + "a" * 216, "a" * 217 + prose(60, rng)]
    texts = [t.encode() for t in texts]
    ix = o10.build(items)
    want = plain_windows(ix, texts)
    assert found_windows(ix, texts) == want and len(want) > 15
    monkeypatch.setattr(o10, "HEAVY", 0)
    assert found_windows(ix, texts) == want
    monkeypatch.setattr(o10, "HITS_AT_ONCE", 50)
    assert found_windows(ix, texts) == want
    monkeypatch.setattr(o10, "HEAVY", 10**9)
    assert found_windows(ix, texts) == want


def test_one_letter_for_a_megabyte():
    began = time.time()
    text = b"a" * (1 << 20)
    ix = o10.build([(1, text.decode()), (2, "ab" * (1 << 19))])
    got = found_windows(ix, [text, b"ab" * (1 << 19)])
    assert got == {(0, 0): ((1 << 20) - 99, 0), (1, 1): ((1 << 20) - 99, 0)} and time.time() - began < 10


def test_every_pair_of_the_smallest_tables(spark):
    """All documents and items: what aligns is found and nothing else is, each pair by whole alignment.

    A window with at most 8 edits keeps one of 9 pieces unchanged, so pairs without a common piece need none.
    """
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pieces, want, shortest = {}, {}, min(len(o10.folded(t)) for _, t in items)
    size = min(shortest, 100) // 9
    for i, t in items:
        x = o10.folded(t).tobytes()
        for k in range(len(x) - size + 1):
            pieces.setdefault(x[k : k + size], set()).add(i)
    index = {i: o10.build([(i, t)]) for i, t in items}
    for d, t in docs:
        x = o10.fold(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
        near = {}
        for k in range(len(x) - size + 1):
            for i in pieces.get(x[k : k + size], ()):
                near.setdefault(i, set()).add(k)
        for i, at in near.items():
            # the places that a window around a common piece can reach, as texts of their own
            spans = []
            for k in sorted(at):
                lo, hi = max(0, k - 110), min(len(x), k + size + 110)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            rows = [v for lo, hi in spans for v in plain_windows(index[i], [x[lo:hi]]).values()]
            if rows:
                want[d, i] = min(r[1] for r in rows)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in o10.matches(docs_of(spark, [(d, t.decode()) for d, t in docs], False), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == want and got


def test_packing_of_long_lists(spark):
    """One token a line, thousands of lines, no blanks; and breaks that are not alone between them."""
    rng = random.Random(14)
    words = [prose(1, rng) + rng.choice(["", "", ",", ".", "7"]) for _ in range(6000)]
    mixed = "".join(w + rng.choice(["\n", "\n", "\n", "\n\n", "\r\n", "\n\t", "\x1c\n"]) for w in words)
    rows = [(1, "\n".join(words)), (2, "\n".join(words) + "\n"), (3, "\n" + "\n".join(words)), (4, mixed), (5, "a b\n" + mixed), (6, "\n".join(map(str, range(20_000)))), (7, "x\n<|endoftext|>\ny\nz")]
    waste, _ = plain_pieces(o8.pack(docs_of(spark, rows), o8.default_tokenizer()).collect(), rows)
    assert waste == 0


def test_secrets_with_a_ledger_are_those_without(spark):
    """A ledger of all, of some and of outdated rows changes what is scanned, never what is told."""
    docs = docs_of(spark, [*SECRET_ROWS, (97, "token=abcdefghijklmnop"), (98, SECRET_ROWS[-3][1])], False)
    tell = lambda ledger=None: sorted((tuple(r) for r in o5.secrets(docs, ledger).collect()), key=str)
    want = tell()
    first = docs.where("doc_id < 34 or doc_id is null").select(F.col("doc_id").alias("path"), "text")
    ledger = materialise(o5.update(first)[1], "ledger")
    assert tell(ledger) == want
    whole = materialise(ledger.unionByName(o5.update(docs.select(F.col("doc_id").alias("path"), "text"), ledger=ledger)[1]), "ledger")
    assert whole.count() == whole.select("blob", "rule", "version").distinct().count()
    assert tell(whole) == want
    assert tell(whole.unionByName(ledger)) == want
    old = whole.withColumn("version", F.when(F.col("rule") == "hex", 0).otherwise(F.col("version"))).withColumn("spans", F.when(F.col("rule") == "hex", F.expr("array(struct(1L AS start, 2L AS stop))")).otherwise(F.col("spans")))
    assert tell(old) == want


def test_language_without_labels_keeps_texts(spark):
    docs = docs_of(spark, [(1, "some words"), (2, "12 !?"), (3, None), (4, "\u00e9"), (None, "x")])
    assert {r["doc_id"] for r in o1.accept(docs, None).collect()} == {1, 4, None}


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, null ids, clashing columns and empty tables go through every stage."""
    import corpus_pipeline
    from test_llm_edges import EDGES

    rows = [*EDGES, *EDGES[-3:], (60, "token = abcdefghijklmnop here"), (61, prose(50)), (62, prose(50)), (None, None)]
    docs = docs_of(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    for some in (docs, docs.limit(0)):
        d = materialise(some, "odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, d, SF), name)
            assert out.columns == docs.columns
            d = out
        left = [(r["doc_id"], r["text"]) for r in d.collect()]
        pieces = corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
        assert sum(r["start"] == 0 for r in pieces) == len(left)
        if some is docs:
            ids = [i for i, _ in left]
            assert {1, 2, 3, 8, 60}.isdisjoint(ids) and {4, 5, 7, 9, 61, 62} <= set(ids) and 6 not in ids and None in ids
