"""Operators against brute force, round trips and held-out accuracy, without Spark."""

import itertools
import random
import re
import zlib
from array import array

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from freightspark.llm import fingerprints, line_dedup, lm_scoring, near_dedup, pii, sentencepiece_codec, token_store, toxicity  # noqa: E402
from freightspark.llm.common import shingle_hashes, word_hashes  # noqa: E402

ODD = ["", " ", "\n", "  hi  there \n x\ty", "don't I'LL <|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|> A", "é́ nbsp x 漢字 \x1c\x00 ©", "".join(map(chr, range(0x100, 0x180))), "İstanbul Straße ÀÉ Ñ, naïve. ſs", "a" * 5000, "😀 ok 😀."]


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]
    got = token_store.encoder(path, 2).encode([t.encode() for t in ODD])
    assert [array("H", g).tolist() for g in got] == want


def test_other_tokenizers_get_whole_texts():
    """One that keeps case and spaces can't be encoded word by word; loading it finds out."""
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    e = token_store.WordEncoder(path, 2)
    assert not e.words and token_store.encoder(public.path("word_bpe_49k.json"), 2).words
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]
    assert [array("H", g).tolist() for g in e.encode([t.encode() for t in ODD])] == want


def test_segment_finds_documents():
    ids, ends = np.arange(40, dtype="<u2"), np.array([3, 3, 10, 30, 40])
    own = [-5, -5, 7, 1 << 40]
    row = {"n_null": 1, "first": -5, "width": 2, "ids": ids.tobytes(), "doc_ids": token_store.EliasFano.encode(np.array(own) + 5).to_bytes(), "bounds": token_store.EliasFano.encode(ends).to_bytes()}
    s = token_store.Segment(row)
    assert [s.doc_id(i) for i in range(len(s))] == [None, *own]
    assert [(a, x.tolist()) for a, x in map(s.document, range(5))] == [(a, ids[a:b].tolist()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    assert (s.find(-5), s.find(7), len(s.find(8)), len(s.find(-9))) == (range(1, 3), range(3, 4), 0, 0)


def test_sentencepiece_parity_and_decoding():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    ids, same = codec.encode(ODD, verify=True)
    assert [array("H", x).tolist() for x in ids] == library.encode(ODD)
    assert all(same)
    assert [codec.decode(x) for x in ids] == ODD


def test_unigram_model_is_read():
    m = sentencepiece_codec.Model(["<unk>", "▁", "a", "▁a", "b"], [0.0, -3.0, -2.0, -1.0, -2.5], [2, 1, 1, 1, 1], sentencepiece_codec.UNIGRAM, False, 0, b"", True, True)
    assert sentencepiece_codec.backend(m).encode("▁ab", add_special_tokens=False).ids == [3, 4]


@pytest.mark.parametrize("seed", range(20))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 300))
    v = np.sort(r.integers(0, int(r.choice([1, 5, 1000, 10**9])), n))
    f = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(v).to_bytes())
    assert f.all().tolist() == v.tolist() == [f[i] for i in range(n)]
    if n > 100:
        assert len(f.low) + len(f.high) < 8 * n


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(1)
    for i in range(8000):
        t = "".join(r.choice("ab.@+-%_ ()0123456789éß\n" if i % 2 else "01.+@-4 a(") for _ in range(r.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == brute_spans(t), t
    assert pii.base_spans("7" * 100_000) == []
    assert pii.base_spans("4111 1111 1111 1111") == [(pii.CARD, 0, 19)]


def test_every_rewritten_form_is_read_whole():
    """In plain letters, without a digit or at sign about: each rewritten form lies in one stretch, and fits its kind."""
    spans = [(pii.EMAIL, "ann.lee@mail.example.com"), (pii.EMAIL, "bo@host.org"), (pii.IP, "10.20.30.40"), (pii.CARD, "4111111111111111"), (pii.PHONE, "+1 (555) 010-0199"), (pii.SECRET, "ab" + "c" * 30 + "9" * 8)]
    g = np.random.default_rng(6)
    for kind, span in spans * 40:
        new = pii.rewritten(kind, span, g)
        if kind == pii.SECRET and not any(c.isdigit() for c in new):
            continue
        text = "plain letters only " * 6 + new + " and more plain letters" * 6
        at = text.index(new)
        assert any(a <= at and at + len(new) <= b for a, b in pii.stretches(text)), new
        assert pii.fits(kind, new), new
    for t in ["".join(random.Random(i).choice("ab@19. ") for _ in range(300)) for i in range(40)]:
        inside = {i for s in pii.stretches(t) for a, b in pii.windows(*s) for i in range(a, b)}
        assert all(j in inside for i, c in enumerate(t) if c in "19@" for j in range(max(0, i - pii.MARGIN), min(len(t), i + pii.MARGIN)))
    assert pii.stretches("look at home. The dot at the end, at most.") == []


def test_network_learns_labelled_spans():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))

    def text():
        part = r.choice([f"{word()}.{r.randint(10, 99)}@{word()}.example.com", ".".join(str(r.randint(1, 255)) for _ in range(4)), f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", word() + str(r.randint(1, 9))])
        return f"{word()} {word()} {word()} {part} {word()} {word()}"

    texts = [text() for _ in range(500)]
    examples = [(p, np.array(y, np.int8)) for i, t in enumerate(texts[:400]) for p, y, _ in pii.examples_of(t, i)]
    net = pii.train(examples, steps=150)
    x, lengths = pii.padded(texts[400:])
    y, _ = net.best(net.emit(x, lengths), lengths)
    right = sum((y[i, : len(t)] == pii.tags_of(pii.base_spans(t), 0, len(t))).all() for i, t in enumerate(texts[400:]))
    assert right >= 85


def test_viterbi_and_marginals_equal_enumeration():
    g = np.random.default_rng(3)
    net = pii.Network.fresh()
    net.w["trans"] = g.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    e, lengths = g.standard_normal((3, 4, pii.TAGS)).astype(np.float32), np.array([4, 2, 1])
    y, p = net.best(e, lengths)
    for i, n in enumerate(lengths.tolist()):
        paths = np.array(list(itertools.product(range(pii.TAGS), repeat=n)))
        score = sum(e[i, t, paths[:, t]] for t in range(n)) + sum(net.w["trans"][paths[:, t - 1], paths[:, t]] for t in range(1, n))
        assert y[i, :n].tolist() == paths[score.argmax()].tolist()
        w = np.exp(score - score.max())
        assert np.allclose(p[i, :n], [w[paths[:, t] == y[i, t]].sum() / w.sum() for t in range(n)], atol=1e-4)


def test_long_stretch_is_one_path():
    """A stretch of many windows: the joined emissions of overlapping windows are averages, and spans across windows stay whole."""
    net = pii.Network.fresh()
    for name in ("trans", "out"):
        net.w[name][:] = 0
    net.w["out_b"][:] = -5
    net.w["out_b"][2 + 2 * pii.CARD] = 5
    assert pii.find(["1" * 1000], net)[0][1] == []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pii, "fits", lambda kind, s: True)
        assert pii.find(["1" * 1000], net)[0][1] == [(pii.CARD, 0, 1000)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, z in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != z)))
    return row[-1]


def test_levenshtein_automaton_equals_distance():
    terms = [toxicity.Term("idiot", False, 5.0), toxicity.Term("worthless", False, 5.0), toxicity.Term("lostra", True, 5.0), toxicity.Term("lowei", True, 5.0)]
    m, r = toxicity.Matcher(terms), random.Random(6)
    words = []
    for _ in range(3000):
        w = list(r.choice(terms).text + r.choice(["", "xy", "s"]))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "o", "é"])
        words.append("".join(w) or "a")
    joined = " ".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    hit, term, errors = m.find(codes, starts, starts + np.array([len(w) for w in words]))
    got = {int(i): int(e) for i, e in zip(hit, errors, strict=True)}
    for i, w in enumerate(words):
        best = [d for t in terms if (d := min(edits(t.text, w[:k]) for k in range(len(w) + 1)) if t.stem else edits(t.text, w)) <= t.errors]
        assert got.get(i) == (min(best) if best else None), w


def test_quotation_counts_less():
    model = toxicity.Model([toxicity.Term("idiot", False, 8.0)])
    m = toxicity.Matcher(model.terms)
    plain, quoted, none = (model.score(toxicity.hits([t], m)[0]) for t in ("you idiot", "“you idiot” is no argument", "you"))
    assert plain > 0.7 > quoted > none


def plain_tree(texts, how, sparse):
    """log10 of any text under context-tree weighting, by recursion over dictionaries."""
    from collections import Counter, defaultdict
    from functools import cache
    from math import log, log10

    depth, seen = lm_scoring.DEPTH, defaultdict(Counter)

    def steps(text):
        data = b"\n" * depth + b" ".join(lm_scoring.words_of(text)) + b"\n"
        for i in range(depth, len(data)):
            yield [data[i - d : i] for d in range(depth + 1)], data[i]

    total = 0
    for t in texts:
        for contexts, byte in steps(t):
            total += 1
            for c in contexts:
                seen[c][byte] += 1
    least = max(2, total**0.5 / sparse)
    known = {c for c, n in seen.items() if not c or n.total() >= least}
    kids = defaultdict(list)
    for c in known:
        if c:
            kids[c[1:]].append(c)

    def path(byte):
        a, n = how.start[byte], how.count[byte]
        return list(zip(how.number[a : a + n].tolist(), how.outcome[a : a + n].tolist(), strict=True))

    @cache
    def counts(c, j):
        out = [0, 0]
        for byte, n in seen[c].items():
            for k, bit in path(byte):
                if k == j:
                    out[bit] += n
        return tuple(out)

    def kt(z, o):
        return sum(log((i + 0.5) / (i + 1)) for i in range(z)) + sum(log((i + 0.5) / (z + i + 1)) for i in range(o))

    def rare(c, j):
        z, o = counts(c, j)
        for k in kids[c]:
            z, o = z - counts(k, j)[0], o - counts(k, j)[1]
        return z, o

    @cache
    def weighted(c, j):
        own = kt(*counts(c, j))
        if len(c) == depth:
            return own
        split = kt(*rare(c, j)) + sum(weighted(k, j) for k in kids[c])
        return np.logaddexp(own, split) - log(2)

    def one(c, j):
        mixed, rest = 0.0, 1.0
        for d in range(len(c) + 1):
            at = c[len(c) - d :]
            z, o = counts(at, j)
            estimate = (o + 0.5) / (z + o + 1)
            share = 1.0 if d == depth else np.exp(kt(z, o) - log(2) - weighted(at, j))
            leaf = mixed + rest * estimate
            if d < depth and sum(rare(at, j)):
                x, y = rare(at, j)
                leaf = mixed + rest * share * estimate + rest * (1 - share) * (y + 0.5) / (x + y + 1)
            mixed, rest = mixed + rest * share * estimate, rest * (1 - share)
        return leaf

    @cache
    def p(c, byte):
        """Of a byte that the context has seen, or of any in the empty context."""
        out = 1.0
        for j, bit in path(byte):
            x = one(c, j) if sum(counts(c, j)) else 0.5
            out *= x if bit else 1 - x
        return out

    def log_p(c, byte):
        if c in known and (not c or seen[c][byte]):
            return log10(p(c, byte))
        escape = 0.0
        if c in known:
            left, there = 1 - sum(p(c, b) for b in seen[c]), 1 - sum(10 ** log_p(c[1:], b) if not seen[c[1:]][b] else p(c[1:], b) for b in seen[c])
            escape = log10(left) - log10(there)
        return escape + log_p(c[1:], byte)

    return lambda text: sum(log_p(contexts[-1], byte) for contexts, byte in steps(text)), log_p, known


def test_table_gives_what_plain_context_tree_weighting_gives():
    r = random.Random(8)
    texts = [" ".join(r.choice(["abra", "cadabra", "hocus", "ab", "ba"]) for _ in range(r.randrange(30))) for _ in range(40)]
    rows = [np.unique(c, return_counts=True) for c, _ in lm_scoring.streams([lm_scoring.words_of(t) for t in texts])]
    codes, inverse = np.unique(np.concatenate([c for c, _ in rows]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([n for _, n in rows])).astype(np.int64)
    how = lm_scoring.Decisions.of(np.bincount(codes & 255, n, minlength=256))
    for sparse in (400, 8):
        levels = lm_scoring.tree(codes, n, how, max(2.0, n.sum() ** 0.5 / sparse), range(lm_scoring.DEPTH + 1))
        for above, level in zip([None, *levels], levels, strict=False):
            level.mix(above)
        table = lm_scoring.Table(*lm_scoring.entries(levels, None, how))
        brute, log_p, known = plain_tree(texts, how, sparse)
        for text in [*texts[:6], "", "abracab hoc xyz", "ÿ" * 9]:
            words = [lm_scoring.words_of(text)]
            assert lm_scoring.text_scores(table, words)[0] == pytest.approx(brute(text), rel=1e-5)
            assert sum(lm_scoring.text_scores(table, words, k, 3)[0] for k in range(3)) == pytest.approx(brute(text), rel=1e-5)
        for c in sorted(known, key=lambda c: (-len(c), c))[::25]:
            assert sum(10 ** log_p(c, b) for b in range(256)) == pytest.approx(1, abs=1e-4)


def test_lgamma():
    import math

    x = np.array([0.5, 1.0, 1.5, 7.25, 1000.5, 1e9])
    assert np.allclose(lm_scoring._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def brute_shingles(text, width=5):
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def test_shingles():
    texts = ["", "one", "One, two!", "a b c d e f g", "a b c d e f g a b c d e", "É a É a É a É"]
    h, n = shingle_hashes(texts, 5)
    brute = [brute_shingles(t) for t in texts]
    assert n.tolist() == [len(b) for b in brute]
    flat = [s for b in brute for s in b]
    assert len(set(h.tolist())) == len(set(flat)) and len({(x, s) for x, s in zip(h.tolist(), flat, strict=True)}) == len(set(flat))
    assert word_hashes(["", " "])[1].tolist() == [0, 0]


def test_sketch_merges_and_estimates():
    r = random.Random(9)
    a = " ".join(str(r.randrange(10**6)) for _ in range(3000))
    b = " ".join(a.split()[:1500]) + " " + " ".join(str(r.randrange(10**6)) for _ in range(1500))
    x, y = fingerprints.sketches([a, b], 256)
    assert abs(fingerprints.resemblance(x, y, 256) - 1 / 3) < 0.12
    assert abs(fingerprints.containment(x, y, 256) - 0.5) < 0.15
    assert abs(fingerprints.distinct_count(x, 256) / 3000 - 1) < 0.25
    assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()
    runs = np.unique(shingle_hashes([a], 5, True)[0])
    assert (fingerprints.merge(runs[::2][:256], runs[1::2][:256], 256) == x).all()


def test_weighted_jaccard_and_samples():
    r = random.Random(10)
    base = [str(r.randrange(10**6)) for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:30] + ["x"] + base[31:200] + ["y"] + base[201:])]
    weights = near_dedup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    a, b = (brute_shingles(t) for t in texts)
    want = len(set(a) & set(b)) / len(set(a) | set(b))
    assert near_dedup.weighted_jaccard(texts[:1], texts[1:], weights)[0] == pytest.approx(want)
    s, n, counts = near_dedup._counted(texts, 5)
    codes = near_dedup.Sampler(2000).draw(s, np.log(n).astype(np.float32), counts)
    assert abs((codes[0] == codes[1]).mean() - want) < 0.04


def test_units_are_the_text_and_chunks_resist_shifts():
    r = random.Random(11)
    sentence = lambda: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 6))) for _ in range(r.randint(3, 9))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(30))
    texts = [f"{sentence()} {sentence()} cut mid {passage} {sentence()}".encode(), f"other words {passage} and so on.".encode()]
    u = line_dedup.Units(texts)
    for i, t in enumerate(texts):
        a, b = int(u.first[i]), int(u.first[i] + u.count[i])
        assert b" ".join(t[int(u.starts[k]) : int(u.ends[k])] for k in range(a, b)).split() == t.split()
    lines = line_dedup.Units([b"a short line.\n\n  another one. here\nend"])
    assert [lines.bytes_of(0, k, k + 1) for k in range(int(lines.count[0]))] == [b"a short line.", b"another one. here", b"end"]
    chunks = [{u.bytes_of(i, *c) for c in u.chunks(i)} for i in range(2)]
    assert sum(map(len, chunks[0] & chunks[1])) > 0.6 * len(passage)


def test_crc_fold():
    assert zlib.crc32(b"12") % 3 == zlib.crc32(str(12).encode()) % 3


def test_masks_hold_every_allowed_pattern():
    from freightspark.llm.decontamination import MASKS, MATCHES, MIN_TOKENS, WINDOW

    for n in range(MIN_TOKENS, WINDOW + 1):
        equal = -(-n * MATCHES // WINDOW)
        for gone in itertools.combinations(range(n), n - equal):
            kept = set(range(n)) - set(gone)
            assert any({at + k for k in mask} <= kept for mask in MASKS for at in range(n - mask[-1])), (n, gone)


def test_leading_shingles_meet():
    """Pairs at any similarity from the threshold on share a leading shingle, whatever the weights."""
    r, texts = random.Random(21), []
    for k in range(40):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(5, 80))] * (1 + k % 2)
        texts += [" ".join(words), " ".join(w if r.random() > 0.03 else "x" for w in words)]
    shingles = np.unique(near_dedup._counted(texts, 5)[0])[::2]
    weights = near_dedup.Weights(shingles, np.random.default_rng(3).uniform(1, 1.5, len(shingles)))
    ids, n = np.unique(near_dedup.Frequent.fold(near_dedup._counted(texts, 5)[0]), return_counts=True)
    often = near_dedup.Frequent(ids[n > 1], n[n > 1])
    assert (often.of(near_dedup._counted(texts[:1], 5)[0]) <= 2).all()
    lead = near_dedup.leading(texts, weights, often, 0.8, 5)
    sets = [dict(zip(lead[1][lead[0] == i].tolist(), lead[3][lead[0] == i].tolist(), strict=True)) for i in range(len(texts))]
    total = dict(zip(lead[0].tolist(), lead[2].tolist(), strict=True))
    pairs = list(itertools.combinations(range(len(texts)), 2))
    same = near_dedup.weighted_jaccard([texts[a] for a, _ in pairs], [texts[b] for _, b in pairs], weights) >= 0.8
    assert 5 < same.sum() < 60 and all(sets[a].keys() & sets[b].keys() for (a, b), s in zip(pairs, same, strict=True) if s)
    most = lambda a, b: max(min(sets[a][x], sets[b][x]) for x in sets[a].keys() & sets[b].keys())
    assert all(most(a, b) >= 0.8 / 1.8 * (1 - 1e-6) * (total[a] + total[b]) for (a, b), s in zip(pairs, same, strict=True) if s)
    assert sum(map(len, sets)) < 0.5 * len(near_dedup._counted(texts, 5)[0])
    # of shingles that follow one another in both texts' orders the first is enough
    order = {i: list(zip(lead[1][lead[0] == i].tolist(), lead[4][lead[0] == i].tolist(), strict=True)) for i in range(len(texts))}
    starts = lambda a, b: [x for x, p in order[a] if (q := dict(order[b]).get(x)) is not None and (p != q or p == 0)]
    first = lambda a, b: next(x for x, _ in order[a] if x in sets[b])
    assert all(first(a, b) in starts(a, b) for (a, b), s in zip(pairs, same, strict=True) if s)
    # similar texts differ in few bits
    weight, bits = near_dedup.parities(near_dedup._counted(texts, 5), weights, 256)
    differ = [int(np.bitwise_count(bits[a] ^ bits[b]).sum()) * 1.5 <= 0.2 / 1.8 * (1 + 1e-6) * (weight[a] + weight[b]) for a, b in pairs]
    assert all(d for d, s in zip(differ, same, strict=True) if s) and sum(differ) < 3 * same.sum()
