"""Each operator on nulls, empty and repeated rows, empty tables and extra columns; results against brute force."""

import hashlib
import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from freightspark.llm import chat, decontamination, fingerprints, line_dedup, lm_scoring, near_dedup, pii, queries, sentencepiece_codec, token_store, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, key string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "k", 0.5) for i, t in rows], DOCS)


def prose(seed, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return " ".join(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w for k, w in enumerate(words))


LONG = prose(99, 20_000)
ODD = [(1, None), (2, ""), (3, "one"), (4, prose(1)), (4, prose(1)), (5, prose(1)), (None, prose(2)), (6, LONG), (7, "\n\n  \t"), (8, prose(1).replace("a", "a", 1) + " tail")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ODD).where("doc_id = -1")


def test_sentencepiece(spark, odd, none):
    path = public.path("piece_bpe_32k.model")
    rows = sentencepiece_codec.encode(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.parity and r.round_trip for r in rows)
    assert [len(r.ids) for r in rows] == [r.n_tokens for r in rows]
    assert sentencepiece_codec.encode(none, path).count() == 0


def test_token_store(spark, odd, none):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t, at, want = Tokenizer.from_file(path), 0, []
    for i, text in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_store.read_digests(token_store.write_tokens(odd, path, 49_408)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.read_digests(token_store.write_tokens(none, path, 49_408)).count() == 0


def test_fingerprints(spark, odd, none):
    order = sorted(ODD, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    for ranges in (4096, 1 << 20):
        rows = fingerprints.with_edits(odd, range_bytes=ranges).collect()
        want = []
        for k, (i, text) in enumerate(order):
            text, following = text or "", order[(k + 1) % len(order)][1] or ""
            n = len(text) // 2
            want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in rows}
    assert by[4].fingerprint == by[5].fingerprint and by[1].fingerprint == by[2].fingerprint == ""
    assert 0.2 < by[6].near_edited < 0.5 and by[6].near_next < 0.1
    assert fingerprints.with_edits(none).count() == 0
    parts = spark.createDataFrame([("a", fingerprints.to_text(s)) for s in fingerprints.sketches([prose(5), prose(6)])], "k string, fingerprint string")
    whole = fingerprints.to_text(fingerprints.merge(*fingerprints.sketches([prose(5), prose(6)])))
    assert fingerprints.merge_fingerprints(parts, ["k"]).collect()[0].fingerprint == whole


def test_pii(spark, odd, none):
    text = "mail a.b@c.example.com or +1 (555) 010-0199 x"
    rows = pii.detect(frame(spark, [*ODD, (9, text)]), None).collect()
    assert len(rows) == len(ODD) + 1
    r = next(r for r in rows if r.doc_id == 9)
    assert (r.n_email, r.n_phone, r.spans) == (1, 1, "email:5:22,phone:26:43")
    assert pii.fit(odd) is None and pii.detect(none, None).count() == 0


def test_pii_network_adds_held_out_spans(spark):
    """Trained on documents with patterned spans; planted, rewritten and mistyped ones in other documents are found."""
    g, r = np.random.default_rng(9), random.Random(9)

    def span(kind):
        if kind == pii.EMAIL:
            return f"{prose(r.random(), 1).lower()}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com"
        if kind == pii.IP:
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == pii.CARD:
            return "".join(str(r.randint(0, 9)) for _ in range(16))
        return f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}" if kind == pii.PHONE else "".join(r.choice("0123456789abcdef") for _ in range(40))

    def text(i, planted):
        kind = i % 5
        own = span(kind)
        shown = pii.rewritten(kind, own, g) if planted and kind in (pii.EMAIL, pii.IP, pii.PHONE) else own
        head = prose(5000 + i, 25) + (' token = "' if kind == pii.SECRET else " ")
        return head + shown + ('" ' if kind == pii.SECRET else " ") + prose(7000 + i, 25), (kind, len(head), len(head) + len(shown))

    net = pii.fit(frame(spark, [(i, text(i, False)[0]) for i in range(400)]), steps=400)
    planted = {i: text(i, True) for i in range(1000, 1200)}
    clean = [(i, prose(i, 60) + " version 2.0, at home 1999. See dot 7") for i in range(2000, 2050)]
    rows = {x.doc_id: x for x in pii.detect(frame(spark, [*((i, t) for i, (t, _) in planted.items()), *clean]), net).collect()}
    found = {i: {*rows[i].spans.split(","), *rows[i].secrets.split(",")} for i in planted}
    hit = [f"{pii.KINDS[k]}:{a}:{b}" in found[i] for i, (_, (k, a, b)) in planted.items()]
    assert sum(hit) >= 0.9 * len(hit)
    assert sum(rows[i].n_added > 0 for i in planted) > 60 and sum(x.n_spans for i, x in rows.items() if i >= 2000) <= 2
    assert sum(x.n_spans for i, x in rows.items() if i < 2000) - sum(hit) <= 20


def test_line_dedup(spark, odd, none):
    passage = prose(7, 80)
    rows = [(10, f"{prose(8, 30)} {passage} {prose(9, 30)}"), (11, f"{prose(10, 30)} {passage}"), (12, prose(11, 60))]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(frame(spark, rows), spans=True).collect()}
    assert got[10].text == rows[0][1] and got[12].text == rows[2][1] and got[10].node == 1
    assert len(got[11].text) < len(rows[1][1]) - 0.8 * len(passage) and got[11].n_chars == len(got[11].text)
    assert got[11].text.startswith(prose(10, 30)[:100])
    out = line_dedup.remove_repeats(odd)
    assert out.schema.names == odd.schema.names and out.count() == len(ODD)
    assert {r.doc_id: r.text for r in out.collect()}[1] is None
    assert line_dedup.remove_repeats(none).count() == 0


def plain_removal(rows):
    """The texts that line dedup leaves, by dictionaries over all chunks."""
    keyed = [(line_dedup.NULL_ID if i is None else i, k, (t or "").encode()) for k, (i, t) in enumerate(rows)]
    units = [line_dedup.Units([t]) for _, _, t in keyed]
    chunks = [u.chunks(0) for u in units]
    order = sorted(range(len(rows)), key=lambda k: keyed[k][:2])
    places = {}
    for k in order:
        for c in chunks[k]:
            places.setdefault(units[k].bytes_of(0, *c), []).append((k, *c))
    listed = {(k, u): v for own in places.values() if len(own) > 1 for k, u, v in own}
    cut_out = [[] for _ in rows]
    for own in places.values():
        one = own[0]
        for k, u, v in own[1:]:
            alike = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            left = 0 if any(kk == k and end == u for (kk, _), end in listed.items()) else alike(units[k].before(0, u), units[one[0]].before(0, one[1]))
            right = 0 if (k, v) in listed else alike(units[k].after(0, v), units[one[0]].after(0, one[2]))
            cut_out[k].append((u - left, v + right))
    out = []
    for k, (_, _, t) in enumerate(keyed):
        u, gone = units[k], set()
        for a, b in cut_out[k]:
            gone |= set(range(int(u.starts[a]), int(u.starts[b]) if b < u.count[0] else len(t)))
        out.append(bytes(c for i, c in enumerate(t) if i not in gone).decode())
    return out


def test_line_dedup_equals_brute_force(spark):
    r, rows = random.Random(17), []
    passages = [prose(700 + k, r.randint(15, 90)).replace(". ", ".\n" if k % 2 else ". ") for k in range(8)]
    for i in range(60):
        parts = [prose(2000 + i, r.randint(5, 60)), r.choice(passages), prose(3000 + i, r.randint(5, 40)), r.choice(passages)]
        rows.append((i, r.choice([" ", "\n"]).join(parts[: r.randint(1, 4)])))
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more words"), (102, "same words " * 200), (103, "é ß " * 90), (None, rows[2][1])]
    want = plain_removal(rows)
    for size, keys in ((1 << 30, 1 << 20), (0, 1 << 20), (0, 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(line_dedup, "LIST_BYTES", size)
            m.setattr(line_dedup, "KEY_BOUND", keys)
            got = {x.doc_id: x.text for x in line_dedup.remove_repeats(frame(spark, rows)).collect()}
        assert [got[i] for i, _ in rows] == want
    assert sum(map(len, want)) < 0.7 * sum(len(t) for _, t in rows)


def test_line_dedup_with_clashing_names(spark):
    df = frame(spark, [(1, prose(1)), (2, prose(1)), (3, "x")])
    for a, b in (("key", "removed"), ("source", "_ranges"), ("lang", "tag"), ("node", "ranges")):
        df = df.withColumnRenamed(a, b)
    got = line_dedup.remove_repeats(df, spans=True)
    assert got.schema.names == [*df.schema.names, "removed_"]
    assert [(r.doc_id, r.removed, len(r.removed_)) for r in got.orderBy("doc_id").collect()] == [(1, "k", 0), (2, "k", 1), (3, "k", 0)]


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join("zz" + str(r.randrange(10**6)) if r.random() < share else w for w in text.split())


def test_near_dedup_equals_brute_force(spark, odd, none):
    rows = [(i, prose(100 + i)) for i in range(0, 120, 4)]
    rows += [(i + 1, changed(t, 0.01, i)) for i, t in rows[:20]] + [(i + 2, t.upper()) for i, t in rows[:5]] + [(i + 3, changed(t, 0.06, i)) for i, t in rows[:20]]
    docs = frame(spark, rows)
    weights = near_dedup.rarity(docs)
    pairs = list(itertools.combinations(range(len(rows)), 2))
    same = near_dedup.weighted_jaccard([rows[a][1] for a, _ in pairs], [rows[b][1] for _, b in pairs], weights) >= near_dedup.SIMILARITY
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), s in zip(pairs, same, strict=True):
        if s:
            a, b = top(rows[a][0]), top(rows[b][0])
            root[max(a, b)] = min(a, b)
    got = {r.node: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == {i: top(i) for i, _ in rows}
    kept = near_dedup.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted({top(i) for i, _ in rows})
    odd_classes = {r.node: r.class_id for r in near_dedup.classes(odd).collect()}
    assert odd_classes[1] == odd_classes[2] == odd_classes[7] == 1 and odd_classes[5] == odd_classes[4] == 4
    assert near_dedup.keep_one(odd).where("doc_id = 4").count() == 1
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c, d = (prose(700 + k) for k in range(4))
    rows = [(2, a), (4, a.upper()), (4, b), (7, c), (9, d), (9, d), (9, c), (None, b), (None, d)]
    docs = frame(spark, rows)
    got = {(r.node, r.class_id) for r in near_dedup.classes(docs).collect()}
    assert {(2, 2), (4, 2), (4, 4), (7, 7), (9, 9), (9, 7)} <= got
    nulls = {n: k for n, k in got if n not in (2, 4, 7, 9)}
    classes = {frozenset(i for i, t in rows if t and t.lower() == x.lower()) for x in (a, b, c, d)}
    assert len(classes) == 4 and set(nulls.values()) <= {*nulls, 4, 9}
    kept = sorted(r.text.lower() for r in near_dedup.keep_one(docs).collect())
    assert kept == sorted(t.lower() for t in (a, b, c, d))


def test_near_dedup_recall_on_given_texts(spark, sf):
    """Pairs of different texts that share shingles, by brute force over all documents: none is left apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    weights = near_dedup.rarity(docs)
    sets = [set(near_dedup._counted([t], 5)[0].tolist()) for _, t in rows]
    holders = {}
    for k, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(k)
    pairs = sorted({p for ks in holders.values() for p in itertools.combinations(ks, 2)})
    same = near_dedup.weighted_jaccard([rows[a][1] for a, _ in pairs], [rows[b][1] for _, b in pairs], weights) >= near_dedup.SIMILARITY
    found = {r.node: r.class_id for r in near_dedup.classes(docs).collect()}
    links = [(rows[a][0], rows[b][0]) for (a, b), s in zip(pairs, same, strict=True) if s]
    together = sum(found[a] == found[b] for a, b in links)
    assert len(links) >= 5 and together >= 0.98 * len(links)


def test_near_dedup_compares_a_large_bucket_in_full(spark):
    """Many families of two that share one long passage: one band puts most of them into one bucket."""
    passage = prose(31, 90)
    rows = []
    for i in range(150):
        text = f"{passage} {prose(600 + i, 40)}"
        rows += [(2 * i, text), (2 * i + 1, text + " " + prose(900 + i, 4))]
    docs = frame(spark, rows)
    weights = near_dedup.rarity(docs)
    key = {r.node: r.bands[0] for r in near_dedup.signatures(docs, weights, bands=1, rows=1).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if key[a] == key[b]]
    same = near_dedup.weighted_jaccard([rows[a][1] for a, _ in pairs], [rows[b][1] for _, b in pairs], weights) >= near_dedup.SIMILARITY
    want = {i: i for i, _ in rows} | {b: a for (a, b), s in zip(pairs, same, strict=True) if s}
    assert len(pairs) > 5000 and 60 < same.sum() <= 150
    for block in (512, 16):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_dedup, "BLOCK", block)
            assert {r.node: r.class_id for r in near_dedup.classes(docs, bands=1, rows=1).collect()} == want


def test_near_dedup_samples_by_inverse_document_frequency(spark):
    """Texts that share a passage of all documents agree in as many samples as their weighted Jaccard similarity by tf * (1 + ln(N / df))."""
    passage = prose(41, 60)
    rows = [(i, f"{passage} {prose(2000 + i // 4, 30)} {prose(3000 + i, 30)}") for i in range(200)]
    docs = frame(spark, rows)
    weights = near_dedup.rarity(docs)
    signed = {r.node: np.array(r.bands) for r in near_dedup.signatures(docs, weights, bands=300, rows=1).collect()}
    sets = [collections.Counter(near_dedup.shingle_hashes([t], 5)[0].tolist()) for _, t in rows]
    df = collections.Counter(x for s in sets for x in s)
    idf = lambda x: 1 + np.log(len(rows) / df[x])
    assert weights.idf(np.array(list(df), np.uint64)) == pytest.approx([idf(x) for x in df], rel=1e-5)

    def similarity(a, b):
        return sum(n * idf(x) for x, n in (sets[a] & sets[b]).items()) / sum(n * idf(x) for x, n in (sets[a] | sets[b]).items())

    for step in (1, 4):  # of one family of four, of different ones
        pairs = [(a, a + step) for a in range(0, 196, 4)]
        got, want = (np.mean([f(a, b) for a, b in pairs]) for f in (lambda a, b: np.mean(signed[a] == signed[b]), similarity))
        assert got == pytest.approx(want, abs=0.03)


def test_decontamination_finds_each_fourth_token_replaced(spark):
    words = [f"tok{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"short{k}" for k in range(8)))], "item_id long, text string")
    leak = " ".join("zz" if k % 4 == 3 else w for k, w in enumerate(words))
    short = " ".join("zz" if k == 3 else f"short{k}" for k in range(8))
    docs = frame(spark, [(1, f"{prose(1, 30)} {leak} {prose(2, 30)}"), (2, f"{prose(3, 30)} {short} {prose(4, 30)}"), (3, prose(5, 60))])
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench).collect()} == {(1, 1), (2, 2)}
    assert [r.doc_id for r in decontamination.without_overlaps(docs, bench).collect()] == [3]


def test_decontamination_equals_brute_force(spark):
    """Random substitutions, insertions and cuts: exactly the pairs with a window that is equal enough."""
    r = random.Random(33)
    items = {k: [f"w{r.randrange(60)}" for _ in range(r.randint(6, 22))] for k in range(40)}
    docs = {}
    for i in range(160):
        own = list(items[i % 40])
        for _ in range(r.randrange(5)):
            own[r.randrange(len(own))] = "zz"
        if r.random() < 0.3:
            own.insert(r.randrange(len(own)), "extra")
        docs[i] = [f"a{i}" for _ in range(r.randrange(4))] + own[: r.randint(5, 30)] + ["end"] * r.randrange(3)
    want = set()
    for i, d in docs.items():
        for k, w in items.items():
            n = min(decontamination.WINDOW, len(w))
            if len(w) >= decontamination.MIN_TOKENS:
                sums = [sum(a == b for a, b in zip(d[x : x + n], w[y : y + n], strict=False)) for x in range(len(d) - n + 1) for y in range(len(w) - n + 1)]
                if max(sums, default=0) * decontamination.WINDOW >= n * decontamination.MATCHES:
                    want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = decontamination.overlaps(frame(spark, [(i, " ".join(d)) for i, d in docs.items()]), bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and 60 < len(want) < 150


def test_clashing_names_are_kept(spark):
    df = frame(spark, [(1, prose(1)), (2, prose(1)), (3, prose(2))]).withColumnsRenamed({"id": "_key", "key": "KEY", "lang": "_node"})
    bench = spark.createDataFrame([(1, prose(2))], "item_id long, text string")
    kept = near_dedup.keep_one(df)
    assert kept.schema.names == df.schema.names and sorted((x.doc_id, x.KEY, x._node, x.node) for x in kept.collect()) == [(1, "k", "en", 1), (3, "k", "en", 1)]
    kept = decontamination.without_overlaps(df, bench)
    assert kept.schema.names == df.schema.names and sorted((x.doc_id, x.KEY, x._key) for x in kept.collect()) == [(1, "k", "x"), (2, "k", "x")]


def test_pipeline_on_odd_tables(spark, odd, none, tmp_path):
    """Nulls, repeated and empty rows, long texts, clashing columns and empty tables go through all stages."""
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, 1, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(50, 30)), (2, None), (None, "a b")], "item_id long, text string")
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        for table, rows in (("documents", docs), ("labels", labels if docs is odd else labels.limit(0)), ("benchmark", bench if docs is odd else bench.limit(0))):
            rows.write.parquet(f"{folder}/{table}.parquet")
        out = corpus_pipeline.run(spark, folder)
        rows = out.collect()
        assert all(x.parity and x.round_trip for x in rows)
        # the empty texts are one class, and so are the two documents of one text; row 8 has what 4 has, and a tail
        assert len(rows) == (0 if docs is none else len({x.doc_id for x in rows}))
        if docs is odd:
            assert {1, 3, 4, 6, None} <= {x.doc_id for x in rows} and not {2, 5, 7} & {x.doc_id for x in rows}


def test_decontamination(spark, odd, none):
    items = [(k, prose(200 + k, 20 + k)) for k in range(12)] + [(50, "too short"), (51, None)]
    r, rows = random.Random(12), []
    for k, text in items[:12]:
        words = text.split()
        for n in (0, 2):
            for at in r.sample(range(len(words)), n):
                words[at] = "changed"
            rows.append((k * 10 + n, f"{prose(300 + k)} {' '.join(words).upper()} {prose(400 + k)}"))
        rows.append((k * 10 + 5, f"{prose(500 + k)} {' '.join(text.split()[:6])}"))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    docs = frame(spark, rows)
    want = {(i, i // 10) for i, _ in rows if i % 10 != 5}
    for bound in (2_000_000, 100):
        assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench, seed_bound=bound).collect()} == want
    kept = decontamination.without_overlaps(docs, bench)
    assert kept.schema.names == docs.schema.names and {r.doc_id % 10 for r in kept.collect()} == {5} and kept.count() == 12
    assert decontamination.without_overlaps(odd, bench).count() == len(ODD)
    assert decontamination.overlaps(none, bench).count() == decontamination.overlaps(docs, bench.where("item_id = -1")).count() == 0


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "<|end|>\n<|user|>\n", "\\", "\\\\<|", "<|>", "a|>b<", "", None, "😀"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(nasty)] + [(2, 0, "assistant", "x", "x"), (3, 0, None, "y", "x"), (None, 1, "user", "z", "x"), (None, 1, "user", "z", "x"), (4, 0, "e<|nd", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(made).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].loss_text == "".join(t or "" for t in nasty[1::2]) and got[1].valid and not got[2].valid and not got[3].valid
    assert [t.role for t in got[4].turns] == ["e<|nd"] and len(got[None].turns) == 2
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_chats(df.where("turn = 99")).count() == 0


def test_toxicity(spark, odd, none):
    r, rows, labels = random.Random(13), [], []
    for i in range(400):
        words = prose(1000 + i, 60).split()
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(["grumpf", "blargle", "snorkid"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert {t.text for t in model.terms} == {"grumpf", "blargle", "snorkid"}
    score = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((score[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in score if zlib.crc32(str(i).encode()) % 3 == 1)
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema.names == docs.schema.names and {x.doc_id % 4 for x in kept.collect()} == {1, 2, 3}
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.terms == [] and toxicity.without_toxic(odd, empty).count() == len(ODD)


def test_lm_scoring(spark, odd, none):
    import math
    import re
    from collections import Counter

    rows = {r.doc_id: r for r in lm_scoring.score(odd, hot_words=20).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    c = Counter(x for i, t in ODD if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in ODD:
        own = tokens(t)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(own), sum(c[x] > 0 for x in own), n)
        assert rows[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own))
        assert rows[i].score < 0
    assert lm_scoring.score(none).count() == 0


def test_lm_scoring_has_one_tree_whatever_the_size_and_the_way_of_a_run(spark):
    texts = ["ab " * 300_000, "xyzqw uvxyzqw", "yzqv", "xyzqw quv", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = F.col("doc_id") != 3
    got = {r.code: (r.every, r.value) for r in lm_scoring.fit(docs.select("text", train.alias("train"))).collect()}

    def runs(own):
        each = np.concatenate([c for c, _ in lm_scoring.streams([lm_scoring.words_of(t) for t in own])])
        return np.unique(each, return_counts=True)

    codes, n = runs([t for i, t in enumerate(texts) if i != 3])
    how = lm_scoring.Decisions.of(np.bincount(codes & 255, n, minlength=256))
    levels = lm_scoring.tree(codes, n, how, 2, range(lm_scoring.DEPTH + 1))
    for above, level in zip([None, *levels], levels, strict=False):
        level.mix(above)
    every, times = runs(texts)
    want = lm_scoring.Table(*lm_scoring.entries(levels, None, how)).log10(every)
    assert set(got) == set(every.tolist())
    for code, k, value in zip(every.tolist(), times.tolist(), want.tolist(), strict=True):
        assert got[code] == (k, pytest.approx(value, rel=1e-4, abs=1e-4))
    far, near = ({r.doc_id: r.score for r in lm_scoring.score(docs, hot_runs=h).collect()} for h in (1, 4_000_000))
    assert far == {i: pytest.approx(v, rel=1e-5) for i, v in near.items()}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 0 < len(ids) <= docs.count() and len(ids) == len(set(ids)) and out.where("not parity or not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    got = queries.queries()[name](spark, sf)
    want = duck.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
