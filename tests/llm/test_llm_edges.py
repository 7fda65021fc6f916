"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm_queries import WORD, edits, plain_groups, plain_pieces

from corridor.llm import _chunks, _text
from corridor.llm import op01_language as o1
from corridor.llm import op02_warc as o2
from corridor.llm import op03_substrings as o3
from corridor.llm import op04_licences as o4
from corridor.llm import op05_secrets as o5
from corridor.llm import op06_nearest as o6
from corridor.llm import op07_jaccard as o7
from corridor.llm import op08_packing as o8
from corridor.llm import op09_quality as o9
from corridor.llm import op10_decontamination as o10

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 7))) for _ in range(300)]
CLASH = ("chunk", "bucket", "kind", "blob", "node", "n", "token", "class", "order", "query", "path", "text_hash", "h", "count")


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def docs_of(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH if clash else ():
        df = df.withColumn(c, F.lit("x"))
    return df


LONG = prose(60_000)
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, LONG + " end"), (7, "é è"), (7, "é è"), (8, "12 !? 34"), (None, "a null id, some words here"), (9, " x y \U0001f600")]


def empty(spark):
    return docs_of(spark, [])


# --- words and hashes


def test_words_are_the_pattern():
    texts = [t for _, t in EDGES] + ["\x0b\x0ca\x1cb\x85c  d\r\n", "x" * 5000]
    data, offs = _text.buffers(pa.array(texts, pa.string()))
    s, e, d = _text.words(data, offs)
    for k, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b, x in zip(s, e, d) if x == k]
        assert got == WORD.findall(t or "")


def test_hashes_do_not_depend_on_neighbours():
    a = ["alpha beta gamma", "Beta", "beta alpha"]
    whole = _text.buffers(pa.array(a))
    s, e, _ = _text.words(*whole)
    h = _text.word_hashes(whole[0], s, e)
    one = []
    for t in a:
        b = _text.buffers(pa.array([t]))
        s1, e1, _ = _text.words(*b)
        one += list(_text.word_hashes(b[0], s1, e1))
    assert h.tolist() == [int(x) for x in one] and h[0] == h[5] and h[1] == h[4] and h[3] != h[1]
    low = _text.word_hashes(whole[0], s, e, lower=True)
    assert low[3] == low[1]


def test_packed_numbers():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (_chunks.unsteps(_chunks.steps(x)) == x).all()
    b = _chunks.bucket_of(x, 7)
    assert (np.diff(b) >= 0).all() and b.max() < 7
    assert _chunks.split_blobs(_chunks.join_blobs(b"ab", b"", b"c")) == [b"ab", b"", b"c"]


# --- 1


def test_language_edges(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "and", "of", "with"] if k % 2 else ["der", "und", "mit", "für"]) for _ in range(40)), "en" if k % 2 else "de") for k in range(80)]
    net = o1.train(spark.createDataFrame([*rows, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    got = {(r["doc_id"], r["lang_pred"]) for r in o1.identify(docs_of(spark, [*EDGES, (10, "der und mit für und der"), (11, "the and of the with")]), net).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (10, "de"), (11, "en")} <= got and (7, "und") not in got
    assert o1.identify(docs_of(spark, EDGES), net).count() == len(EDGES) and o1.identify(empty(spark), net).count() == 0
    nobody = o1.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in o1.identify(docs_of(spark, EDGES), nobody).collect()} == {"und"}
    kept = o1.accept(docs_of(spark, EDGES), net)
    assert len(kept.columns) == 2 + len(CLASH) and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, None, 9}


def test_windows_hold_every_byte():
    texts = ["a" * 700, "", "b" * 256, "c"]
    data, offs = _text.buffers(pa.array(texts))
    x, doc, size = o1.windows(data, offs)
    assert doc.tolist() == [0, 0, 0, 2, 3] and size.tolist() == [256, 256, 188, 256, 1]
    assert all(b"".join(w.tobytes() for w in x[doc == k]).rstrip(b"\0").decode() == t for k, t in enumerate(texts))


def test_network_tables_are_the_network():
    net = o1.Network(["a", "b"])
    x = np.random.default_rng(0).integers(1, 256, (5, o1.LENGTH)).astype(np.uint8)
    emb, z = net.p["emb"][x], []
    for w in o1.WIDTHS:
        n = o1.LENGTH - w + 1
        z.append((sum(emb[:, j : j + n] @ net.p[f"w{w}"][j] for j in range(w)) + net.p[f"b{w}"]).max(1))
    logit = np.maximum(np.concatenate(z, 1), 0) @ net.p["out"] + net.p["bias"]
    p = np.exp(logit - logit.max(1, keepdims=True))
    assert np.allclose(net.predict(x, net.tables()), p / p.sum(1, keepdims=True), atol=1e-5)


def test_whole_texts_by_a_plain_network(spark):
    """Every document's language and score: windows cut and convolved one by one, their answers weighed by bytes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, LONG, None), (-2, "é" * 300, None), (-3, "A\0b" * 90, None)], "doc_id long, text string, lang string"))
    net = o1.train(docs.where(~o1.fold()))

    def plain(window):
        x = np.frombuffer(window.ljust(o1.LENGTH, b"\0").replace(b"\0", b"\0"), np.uint8)
        z = []
        for w in o1.WIDTHS:
            z.append(np.max([sum(net.p["emb"][x[i + j]] @ net.p[f"w{w}"][j] for j in range(w)) + net.p[f"b{w}"] for i in range(o1.LENGTH - w + 1)], axis=0))
        v = np.maximum(np.concatenate(z), 0) @ net.p["out"] + net.p["bias"]
        e = np.exp(v - v.max())
        return e / e.sum()

    got = {r["doc_id"]: r for r in o1.identify(docs, net).collect()}
    rows = docs.collect()
    few = [r for r in rows if r["doc_id"] < 0] + [r for r in rows if r["text"] and len(r["text"].encode()) < 1500][:60]
    for i, text, _ in few:
        raw = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 0 else c for c in (text or "").encode())
        raw = raw[: 256 * 12] if len(raw) > 256 * 400 else raw
        if len(raw) < len((text or "").encode()):
            part = o1.identify(spark.createDataFrame([(i, raw.decode())], "doc_id long, text string"), net).first()
        else:
            part = got[i]
        cuts = [raw[k : k + 256] for k in range(0, len(raw), 256)]
        p = sum(plain(c) * len(c) for c in cuts) / len(raw)
        if any(ch.isalpha() for ch in text):
            assert abs(part["score"] - p.max()) < 1e-4 and (part["lang_pred"] == net.classes[int(p.argmax())] or np.diff(np.sort(p)[-2:])[0] < 1e-4)
        else:
            assert part["lang_pred"] == "und" and part["score"] == 0


# --- 2


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("response", F.lit(2))


def test_warc_edges(spark):
    big, same = "é" * 500, "x" * 1000
    rows = [(1, "http://a b/\n", big), (5, None, big), (3, "u", big), (3, "u", big), (5, "v", big), (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (None, "u", same), (2, "u", same), (None, "w", "z" * 2000), (None, "w", "z" * 2000)]
    got = sorted((tuple(r) for r in o2.read_archives(o2.pages_to_warc(pages_of(spark, rows))).collect()), key=str)
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        group = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        top = max(group) if group and len(p) >= 1000 else None
        revisit = top is not None and i != top
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)
    assert o2.read_archives(o2.pages_to_warc(pages_of(spark, []))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nbody\nURL 1.1.1.1 \n", b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\n"]
    data = o2.arc_header("a.arc", version) + b"".join(o2.arc_record(f"http://x/ {k}", "1.2.3.4", "20200102030405", "text/html", b, version, "a.arc", 0) for k, b in enumerate(blocks))
    head, *records = o2.parse_arc(data)
    assert head["version"] == version and [r["block"] for r in records] == blocks and records[0]["URL"] == "http://x/%200"
    warc = o2.convert(head, "a") + b"".join(o2.convert(r, "a", None if k != 1 else (9, "http://y/", "20190102030405")) for k, r in enumerate(records))
    (h, _), (h0, b0), (h1, b1) = o2.read_warc(warc)
    assert h["WARC-Type"] == "warcinfo" and h["WARC-Date"] == "2024-01-01T00:00:00Z"
    assert h0["WARC-Type"] == "response" and h0["WARC-Date"] == "2020-01-02T03:04:05Z" and b0 == blocks[0]
    assert h1["WARC-Type"] == "revisit" and h1["WARC-Refers-To-Target-URI"] == "http://y/" and h1["WARC-Refers-To-Date"] == "2019-01-02T03:04:05Z" and b1 == blocks[1]
    assert len({x["WARC-Record-ID"] for x in (h, h0, h1)}) == 3
    with pytest.raises(o2.ArcError):
        list(o2.parse_arc(data[:-3]))
    with pytest.raises(o2.ArcError):
        list(o2.parse_arc(data.replace(f"{version} 0 corridor".encode(), b"7 0 corridor")))


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_arcs(version):
    """Records of other writers: name look-ups, plain HTTP without our header, bare bodies, short dates, CR LF."""
    body = f"{version} 1 Some Crawler\n{o2.ARC_FIELDS[version]}\n<arcmetadata/>\n".encode()
    head = "filedesc:///old/IA-2001.arc 0.0.0.0 20011231235958 text/plain " + ("200 - - 0 IA-2001.arc " if version == 2 else "")
    blocks = [("dns:example.org", "text/dns", b"20011231235959\nexample.org. 300 IN A 1.2.3.4\n"), ("http://example.org/a b", "text/html", b"HTTP/1.0 200 OK\nServer: x\n\n<p>\r\n\r\nX-Page-Id: 7\r\n</p>"), ("ftp://x/y", "text/plain", b"no header here"), ("http://x/", "text/html", b"HTTP/1.0 304 Not Modified\r\n"), ("http://e/", "text/html", b"")]
    data = f"{head}{len(body)}\n".encode() + body
    for url, mime, block in blocks:
        line = f"{url} 1.2.3.4 200112312359 {mime} " + ("200 abc - 5 IA-2001.arc " if version == 2 else "")
        data += f"{line}{len(block)}\n".encode() + block + b"\r\n"
    first, *records = o2.parse_arc(data)
    assert [(r["URL"], r["block"]) for r in records] == [(u, b) for u, _, b in blocks]
    got = list(o2.read_warc(b"".join(o2.convert(r, "IA-2001.warc.gz") for r in (first, *records))))
    assert got[0][0]["WARC-Date"] == "2001-12-31T23:59:58Z" and all(h["WARC-Date"] == "2001-12-31T23:59:00Z" for h, _ in got[1:])
    assert [h["WARC-Type"] for h, _ in got] == ["warcinfo", "resource", "response", "resource", "response", "resource"]
    assert [h["Content-Type"] for h, _ in got[1:4]] == ["text/dns", "application/http; msgtype=response", "text/plain"]
    assert [b for _, b in got[1:]] == [b for _, _, b in blocks] and got[2][0]["X-Payload-Length"] == str(len(b"<p>\r\n\r\nX-Page-Id: 7\r\n</p>"))
    assert len({h["WARC-Record-ID"] for h, _ in got}) == len(got) and o2.warc_date("2001") == "2001-01-01T00:00:00Z"
    rows = pa.Table.from_batches(o2._read(iter([pa.RecordBatch.from_arrays([pa.array([b"".join(o2.convert(r, "a") for r in (first, *records))], pa.binary())], names=["content"])]))).to_pylist()
    assert [r["page_id"] for r in rows] == [None] * 5 and {r["record_type"] for r in rows} == {"resource", "response"}


# --- 3


def plain_removal(rows, k):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    key = [i if i is not None else 2**63 for i, _ in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, key[d]), key[d])
    out = []
    for d, w in enumerate(words):
        gone = {i + j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < key[d] for j in range(k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((rows[d][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("k", [3, 13, 20, 40])
def test_substrings(spark, k):
    rng = random.Random(k)
    shared = [prose(n, rng) for n in (k - 1, k, k + 1, 3 * k, 100)]
    rows = [*EDGES[:4], *EDGES[6:]]
    for d in range(60):
        parts = [prose(rng.randint(0, 30), rng)] + [rng.choice(shared) if rng.random() < 0.5 else prose(rng.randint(1, 25), rng) for _ in range(5)]
        rows.append((rng.choice([d, 7, None]) if d % 9 == 0 else 100 + d, " ".join(parts)))
    got = sorted((tuple(r) for r in o3.remove_repeats(docs_of(spark, rows), k).collect()), key=str)
    assert got == sorted(plain_removal(rows, k), key=str)


def test_substrings_edges(spark):
    assert o3.levels(13) == [7, 13] and o3.levels(40) == [5, 10, 20, 40] and o3.levels(3) == [3]
    rows = [(2, LONG), (1, LONG + " tail"), (1, LONG + " tail")]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in o3.remove_repeats(docs_of(spark, rows), 13).collect()}
    assert got == {(2, 60_000, 60_000), (1, 60_001, 0)}
    assert o3.remove_repeats(empty(spark)).count() == 0
    apart = [(k, prose(30, random.Random(k))) for k in range(5)]  # nothing survives the first level
    assert sorted(tuple(r) for r in o3.remove_repeats(docs_of(spark, apart)).collect()) == sorted(plain_removal(apart, 13))


def test_largest_and_smallest_ids(spark):
    """The largest long is an id as any other and comes before a null one; so with the smallest."""
    same = prose(40)
    rows = [(2**63 - 1, same), (None, same + " tail"), (None, prose(20)), (-(2**63), prose(9)), (2**63 - 2, prose(3) + " " + same), (2**63 - 1, same)]
    got = sorted((tuple(r) for r in o3.remove_repeats(docs_of(spark, rows, False)).collect()), key=str)
    assert got == sorted(plain_removal(rows, 13), key=str) and sum(r[2] for r in got) == 120
    late = [(None, same), (2**63 - 1, same)]
    got = {(r["doc_id"], r["n_removed"]) for r in o3.remove_repeats(docs_of(spark, late, False)).collect()}
    assert got == {(None, 40), (2**63 - 1, 0)}
    # the same in chunks apart from each other
    far = docs_of(spark, [late[0]], False).repartition(1).unionByName(docs_of(spark, [late[1]], False).repartition(1))
    assert {(r["doc_id"], r["n_removed"]) for r in o3.remove_repeats(far).collect()} == {(None, 40), (2**63 - 1, 0)}
    got = sorted((tuple(r) for r in o7.groups(docs_of(spark, rows, False)).collect()), key=str)
    assert got == sorted(plain_groups(rows, 4, 85), key=str) and (2**63 - 1) in {r[2] for r in got} | {r[0] for r in got}


def test_many_buckets_for_few_keys():
    """A chunk's rows are at most its keys, and its work does not grow with the buckets."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64))
    for n in (1, 7, 10**9):
        rows = _chunks.send(5, keys, n, lambda part, own: _chunks.steps(part))
        assert len(rows) <= len(keys) and [b for _, b, _ in rows] == sorted({b for _, b, _ in rows})
        assert np.concatenate([_chunks.unsteps(x) for _, _, x in rows]).tolist() == keys.tolist()
        assert all((_chunks.bucket_of(_chunks.unsteps(x), n) == b).all() for _, b, x in rows)
    for size in (0, 1, 32, 33, 5000):
        for kind in (np.uint8, np.uint32, np.int64, np.uint64):
            x = np.arange(size).astype(kind)
            assert (_chunks.expand(_chunks.squeeze(x), kind) == x).all() and len(_chunks.expand(_chunks.squeeze(x), kind)) == size


# --- 4


def test_licence_rules():
    ids = ["mit-grant", "mit-condition", "x", "mit-as-is", "mit-liability", "mit-notice"]
    assert [(m[0], m[1], m[2]) for m in o4.match(ids, list(range(6)))] == [(0, 4, "MIT"), (5, 5, "MIT")]
    assert [m[2] for m in o4.match(["gpl-free", "gpl3-or-later"], [0, 9])] == []  # too far apart
    assert [m[2] for m in o4.match(["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is"], [0, 1, 2, 3, 4])] == ["BSD-3-Clause"]
    assert o4.match([], []) == []
    assert all(s in o4.SENTENCES for _, rule in o4.RULES for s in rule)


def test_licence_rules_by_search(spark):
    """Random runs of known and unknown sentences: every choice of places is tried for every rule."""
    from itertools import product

    def plain(ids):
        known = [k for k, x in enumerate(ids) if x]
        found = []
        for licence, rule in o4.RULES:
            places = [[k for k in known if ids[k] == want] for want in rule]
            ends = {}
            for chosen in product(*places):
                if all(a < b <= a + o4.GAP + 1 for a, b in zip(chosen, chosen[1:])):
                    ends[chosen[0]] = min(chosen[-1], ends.get(chosen[0], chosen[-1]))
            found += [(-len(rule), a, licence, b) for a, b in ends.items()]
        out, used = [], set()
        for _, a, licence, b in sorted(found):
            own = {k for k in known if a <= k <= b}
            if not own & used:
                used |= own
                out.append(licence)
        return sorted(out)

    rng, rows, want = random.Random(21), [], {}
    several = [r for r in o4.RULES if len(r[1]) > 1]
    for d in range(300):
        ids = []
        for _ in range(rng.randint(1, 3)):
            _, rule = rng.choice(several)
            for name in rule:
                if rng.random() < 0.93:
                    ids.append(name)
                if rng.random() < 0.1:
                    ids.append(rng.choice(rule))
                ids += [None] * rng.choice([0, 0, 0, 1, 2, 3])
        known = [k for k, x in enumerate(ids) if x]
        assert sorted(x[2] for x in o4.match([ids[k] for k in known], known)) == plain(ids)
        # as a text, a sentence a line; sentences that hold stops of their own are left out
        if all("http" not in o4.SENTENCES[x] and x not in ("mpl-form", "gpl2-or-later", "apache-header") and not re.search(r"[.!?:;]\s", o4.SENTENCES[x]) for x in ids if x):
            rows.append((d, "\n".join(o4.SENTENCES[x] if x else "Something else stands here." for x in ids)))
            want[d] = sorted(set(plain(ids)))
    got = {r["doc_id"]: r["licences"] for r in o4.scan(docs_of(spark, rows)).collect()}
    assert got == want and len(want) > 40 and any(len(v) > 1 for v in want.values())


def test_licence_texts(spark):
    full = lambda names, sep: sep.join(o4.SENTENCES[n] for n in names)
    wrapped = re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n", full(o4.RULES[0][1], " "))
    rows = [*EDGES, (20, prose(30) + "\n\n" + wrapped + "\n\n" + prose(5)), (21, full(o4.RULES[5][1], "\n * ")), (22, "RELEASED   under the *MIT* License.\nLicensed under CC BY-NC 4.0."), (23, "Released under the MIT Licensee."), (24, full(o4.RULES[9][1], " ")), (25, full(o4.RULES[11][1], "  "))]
    got = {r["doc_id"]: r for r in o4.scan(docs_of(spark, rows)).collect()}
    assert [got[k]["licences"] for k in (20, 21, 22, 23, 24, 25)] == [["MIT"], ["BSD-2-Clause"], ["CC-BY-NC-4.0", "MIT"], [], ["GPL-3.0-or-later"], ["GPL-2.0-or-later"]]
    assert got[20]["n_matches"] == 1 and all(got[k]["n_matches"] == 0 for k in (1, 2, 3, 4, 5, 8))
    assert o4.scan(empty(spark)).count() == 0


# --- 5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = (("assign", ASSIGN, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16))


def plain_secrets(i, text):
    t, found = text or "", []
    for order, (kind, pattern, ok) in enumerate(KINDS):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(t) if ok(m)]
    names = [x[2] for x in sorted(found)]
    n = lambda k: sum(x.startswith(k + ":") for x in names)
    return i, n("assign"), n("access"), n("hex"), hashlib.sha256(",".join(names).encode()).hexdigest()


SECRET_ROWS = [
    *EDGES,
    (30, "token: secret: longvalue123456 PASSWORD = 'abcdefghijkl' api_key=short apikey=\"0123456789abcdef0123\""),
    (31, "é\U0001f600 token=abcdefghijkl0123456789abcdef AKIAAKIA AKIA1234567890ABCD AKIA1234567890ABC"),
    (32, "0123456789abcde 0123456789abcdef f" + "0" * 40 + "g" + "a" * 16),
    (33, "paſſword=abcdefghijklmn"),
    (34, "-----BEGIN RSA PRIVATE KEY-----\n" + "ab" * 20),
    (35, "token = \t abcdefghijklmnop"),
    (36, " ".join(f"secret{k}" + f" {k:016x}" for k in range(3000))),
]


def test_secrets(spark):
    rows = SECRET_ROWS + [(40, SECRET_ROWS[-2][1]), (30, SECRET_ROWS[11][1])]
    got = sorted((tuple(r)[:5] for r in o5.secrets(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted((plain_secrets(*r) for r in rows), key=str)
    spans = {r["doc_id"]: r["spans"] for r in o5.secrets(docs_of(spark, rows)).collect()}
    assert spans[34].startswith("pem:0:31,hex:") and spans[1] == ""
    assert o5.secrets(empty(spark)).count() == 0
    clean = {r["doc_id"] for r in o5.without_secrets(docs_of(spark, rows)).collect()}
    assert 30 not in clean and 34 not in clean and {1, 2, 4, 33, 35, None} <= clean


def test_ledger_is_incremental(spark):
    v = docs_of(spark, SECRET_ROWS, False).select(F.col("doc_id").alias("path"), "text")
    found, ledger = o5.update(v)
    blobs = len({t or "" for _, t in SECRET_ROWS})
    assert ledger.count() == blobs * len(o5.RULES) and found.count() > 0
    again, more = o5.update(v, ledger=ledger)
    assert again.count() == 0 and more.count() == 0
    rules = (*o5.RULES[:3], o5.Rule("pem", o5.RULES[3].pattern, version=2, base=False))
    again, more = o5.update(v, rules, ledger)
    assert {r["rule"] for r in more.collect()} == {"pem"} and more.count() == blobs and {r["rule"] for r in again.collect()} == {"pem"}
    fresh = v.unionByName(spark.createDataFrame([(99, "token=abcdefghijklmnop")], "path long, text string"))
    again, more = o5.update(fresh, ledger=ledger)
    assert more.count() == len(o5.RULES) and {r["rule"] for r in again.collect()} == {"assign"}


def test_secrets_plan_is_native(spark):
    plan = o5.secrets(docs_of(spark, SECRET_ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 6


def test_nearest_edges(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 8))
    rows = [(k, base[k].tolist()) for k in range(150)]
    rows += [(200 + k, base[7].tolist()) for k in range(60)]  # equal vectors
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] + [1.0] * 7), (304, [float("inf")] + [1.0] * 7), (305, [1.0] * 7), (None, base[3].tolist()), (20, base[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class", F.lit(0)).withColumn("digest", F.lit("x"))
    got = {}
    for r in o6.nearest(df, F.col("id") % 20 == 0, probes=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    usable = {i: np.array(v) for i, v in rows if i is not None and (i < 150 or 200 <= i < 260)}
    assert sorted(got) == sorted(i for i in usable if i % 20 == 0)
    for q, mine in got.items():
        s = sorted(((float(usable[q] @ v), -i) for i, v in usable.items() if i != q), reverse=True)[:20]
        assert [i for i, _ in mine] == [-i for _, i in s] and np.allclose([x for _, x in mine], [x for x, _ in s], atol=1e-12)
    # nothing is met often enough: every query is searched exactly, to the same rows
    told = lambda **more: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in o6.nearest(df, F.col("id") % 20 == 0, **more).collect())
    assert told(tables=2, probes=1, stray=0.0) == told(probes=1000)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert o6.nearest(few, F.col("id") == 0).count() == 4
    assert o6.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_rotation_keeps_length():
    x = np.random.default_rng(0).normal(size=(3, 16))
    r = o6.rotate(x, np.random.default_rng(1).choice([-1.0, 1.0], (3, 16)))
    assert np.allclose(np.linalg.norm(r, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(r @ r.T, x @ x.T)


# --- 7


def near_copies(rng, n, words, rate):
    base = prose(words, rng).split()
    return [" ".join(rng.choice(VOCABULARY) if rng.random() < rate else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("percent,rate", [(85, 0.02), (85, 0.01), (80, 0.03)])
def test_jaccard_is_all_pairs(spark, percent, rate):
    rng = random.Random(percent * rate)
    texts = near_copies(rng, 60, 80, rate) + near_copies(rng, 25, 200, rate) + near_copies(rng, 25, 12, rate) + [prose(rng.randint(1, 60), rng) for _ in range(30)]
    passage = prose(60, rng)
    texts += [passage + " " + prose(rng.randint(1, 12), rng) for _ in range(30)]
    rows = [*EDGES, *[(1000 - k, t) for k, t in enumerate(texts)], *[(2000 + k, t.upper()) for k, t in enumerate(texts[:20])]]
    got = sorted((tuple(r) for r in o7.groups(docs_of(spark, rows), 4, percent).collect()), key=str)
    assert got == sorted(plain_groups(rows, 4, percent), key=str)


def test_jaccard_edges(spark):
    assert o7.groups(empty(spark)).count() == 0
    tie = "a b c d e f g h i j k l m n o p q"  # 14 shingles
    rows = [(1, tie), (2, tie + " r s"), (3, "a b c"), (4, "a  B c"), (5, "a b")]
    assert sorted(tuple(r) for r in o7.groups(docs_of(spark, rows), 4, 85).collect()) == sorted(plain_groups(rows, 4, 85))
    kept = {r["doc_id"] for r in o7.keep_one(docs_of(spark, [*rows, (None, tie)]), 5, 80).collect()}
    assert kept == {1, 3, 5, None}


# --- 8


def test_packing_edges(spark):
    rows = [*EDGES[:6], (50, "  two  blanks \n\n and don't <|endoftext|> x"), (51, "x" * 3000), *[(60 + k, prose(RNG.randint(0, 400))) for k in range(60)]]
    pieces = o8.pack(docs_of(spark, rows).repartition(3), o8.default_tokenizer()).collect()
    waste, _ = plain_pieces(pieces, rows)
    assert waste == 0 and o8.pack(empty(spark), o8.default_tokenizer()).count() == 0
    odd = o8.pack(docs_of(spark, EDGES), o8.default_tokenizer()).collect()
    assert sum(r["doc_id"] == 7 for r in odd) >= 2 and any(r["doc_id"] is None for r in odd)


def test_sum_of_squares_choice():
    rng, w, cut = random.Random(2), 32, 0
    for most in (1, 4, 60):
        bins = o8.SumOfSquares(w, most)
        filled: dict[int, int] = {}
        for _ in range(700):
            s = rng.randint(1, w - 1) if rng.random() < 0.5 else rng.randint(w // 2 + 1, w - 1)
            n, few = list(bins.level), bins.held < most

            def cost(fill, n=n, s=s):
                after = n.copy()
                if fill:
                    after[fill] -= 1
                if fill + s < w:
                    after[fill + s] += 1
                return sum(x * x for x in after)

            options = [f for f in range(w - s + 1) if (f == 0 and few) or (f and n[f])]
            parts = bins.place(s)
            if options:
                assert len(parts) == 1 and cost(parts[0][1]) == min(map(cost, options))
            else:
                cut += 1
                assert len(parts) > 1 and all(fill + size == w for _, fill, size in parts[:-1])
            for seq, fill, size in parts:
                assert filled.get(seq, 0) == fill
                filled[seq] = fill + size
            assert sum(size for *_, size in parts) == s and bins.held <= most
            assert bins.level == [len(bins.open.get(f, [])) for f in range(w + 1)] and sum(bins.level) == bins.held
    assert cut > 100


def test_ids_are_the_tokenizers(monkeypatch):
    """Random texts of all kinds of characters, with a cache that turns over all the time."""
    monkeypatch.setattr(o8, "CACHE_WORDS", 40)
    tok, rng = o8.WordTokenizer(o8.default_tokenizer()), random.Random(31)
    kinds = ["abcXYZ", "0123456789", "'!?.,-_/\"<|>$", "'s't've'll'd'RE", " ", "  ", "\n", "\t\r\n", "éßλ中ſ", "\u00a0\u2003\x85", "\U0001f600٣²", "the of and "]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            text += rng.choice(["<|endoftext|>", "it's we'll 'tis", " ", "\n\n", "12,345.67", "a\n b", "x  y"]) + rng.choice(["", "z", " "])
        want = [*tok.tokenizer.encode(text, add_special_tokens=False).ids, o8.END_ID]
        assert np.frombuffer(tok.ids(text), np.uint32).tolist() == want, text


def test_few_windows_are_open(spark):
    """Pieces above half a window: none fits with another, yet few are held, and few ids are left for the end."""
    rows = [(k, "word " * 699 + "x") for k in range(300)]
    pieces = [r.asDict() for r in o8.pack(docs_of(spark, rows, False).repartition(1), o8.default_tokenizer()).collect()]
    waste, total = plain_pieces(pieces, rows)
    assert waste == 0 and sum(r["length"] == r["doc_tokens"] for r in pieces) > 60
    full = {}
    for r in pieces:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert sum(n for n in full.values() if n == 1024) > total - 1024


# --- 9


def test_quality_edges(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        toxic, good = k % 3 == 0, k % 2
        rows.append((k, prose(40, rng) + (" idiot! scum" if toxic else "") + ("" if good else " BUY!! NOW!!")))
        labels.append((k, good, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = o9.train(docs_of(spark, rows), lab)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in o9.score(docs_of(spark, [*rows, *[(9000 + k, t) for k, (_, t) in enumerate(EDGES)]]), model).collect()}
    means = [np.mean([got[i]["expected_grade"] for i, g, t in labels if (0 if t else 1 + g) == grade]) for grade in range(3)]
    assert means[0] < means[1] < means[2] and got[9000]["tail"] == got[9001]["tail"] == got[9002]["tail"]
    assert o9.score(empty(spark), model).count() == 0
    nothing = o9.train(docs_of(spark, rows), lab.limit(0))
    assert nothing is None and o9.score(docs_of(spark, rows[:2]), nothing).first()["tail"] is None


# --- 10


def test_decontamination_edges(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng.randint(20, 50), rng)) for k in range(12)] + [(50, None), (51, ""), (52, "tiny"), (None, prose(30, rng))]
    rows = [*EDGES]
    for k in range(12):
        t = items[k][1]
        broken = list(t)
        for j in range(0, len(broken), 40):
            broken[j] = "z"
        rows += [(100 + k, prose(40, rng) + "\n" + t + " " + prose(10, rng)), (200 + k, prose(20, rng) + " " + "".join(broken).upper().replace(" ", " ,  ")), (300 + k, prose(150, rng)), (400 + k, " ".join(rng.sample(t.split(), len(t.split()))))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in o10.matches(docs_of(spark, rows), bench).collect()}
    assert got == {(100 + k, k) for k in range(12)} | {(200 + k, k) for k in range(12)}
    kept = o10.clean(docs_of(spark, rows), bench)
    assert len(kept.columns) == 2 + len(CLASH) and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    assert o10.matches(empty(spark), bench).count() == 0 and o10.matches(docs_of(spark, rows), bench.limit(0)).count() == 0
    # small blocks: items cut into parts, several blocks in one pass; the rows are the same
    whole = sorted(o10.matches(docs_of(spark, rows), bench).collect())
    monkeypatch.setattr(o10, "BLOCK_CHARS", 130)
    blocks = list(o10.blocks(bench, "item_id", "text"))
    assert len(blocks) > 12 and max(len(ix.body) for ix in blocks) <= 130 + o10.WINDOW
    assert sorted(o10.matches(docs_of(spark, rows), bench).collect()) == whole
    assert {r["doc_id"] for r in o10.clean(docs_of(spark, rows), bench).collect()} == {r[0] for r in rows} - {d for d, _ in got}


def test_alignment_is_cell_by_cell():
    rng = random.Random(8)
    for _ in range(40):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        assert int(o10.align(np.frombuffer(p, np.uint8), np.frombuffer(t, np.uint8)[None])[0]) == edits(p, t)


def test_lemma_holds():
    """A window with e edits keeps at least the needed grams on e + 1 neighbouring diagonals."""
    rng = random.Random(9)
    for _ in range(100):
        text = prose(40, rng)[:100]
        ix = o10.build([(1, text)])
        w, e, need = ix.text[0].tobytes(), int(ix.edits[0]), int(ix.need[0])
        t = list(w)
        for _ in range(e):
            j = rng.randrange(len(t))
            kind = rng.random()
            if kind < 0.34:
                t[j] = 122
            elif kind < 0.67:
                del t[j]
            else:
                t.insert(j, 122)
        t = bytes(t)
        hits = [(i - j) for i in range(len(t) - 7) for j in range(len(w) - 7) if t[i : i + 8] == w[j : j + 8]]
        assert max(sum(d <= h <= d + 2 * e for h in hits) for d in range(-2 * e, e + 1)) >= need


def test_fold_of_ids():
    assert zlib.crc32(b"2") % 4 in range(4)
