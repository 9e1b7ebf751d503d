"""Source divergence, collocations and packing against their definitions, on small awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import compare
import numpy as np
import pytest

from ruleweave.llm import collocations, divergence, packing, queries, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n long, phrase string, ids string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma", "DELTA", "is", "the", "of", "été", "日本", "x", "w v"]
    joins = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", " ; ", "!"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(joins) for _ in range(n))
    out = []
    for i in range(160):
        lang = rnd.choice(["en", "en", "de", None, ""])
        source = rnd.choice(["hot", "hot", "s1", "s2", "s3", "s4", "s5", "s6", None, ""])
        own = f" only{source} " * rnd.randint(0, 4) if source in ("s1", "s2") else ""
        out.append((i, text(rnd.randint(0, 60)) + own + ("rare pair here " if i % 7 == 0 else ""), lang, source, 3, "p", "q"))
    out += [(200, None, "en", "s1", None, None, None), (201, "", "xx", "lonely", 1, "", ""), (None, None, None, None, None, None, None), (202, text(3000), "en", "s9", 1, "", ""), out[0], out[0], (203, "same same. " * 40, "en", "hot", 1, "", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(df, want):
    key = lambda r: [(x is None, str(x)) for x in r]
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want) and got == want


def divergence_by_definition(rows, least, top):
    terms = defaultdict(Counter)
    docs = defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        terms[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {k[0] for k in terms}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = sorted(s for k, s in terms if k == lang)

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(terms[lang, s]) for s in groups}
        q = share(sum((terms[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            found = [(q[t] - p[s][t], t.encode(), t) for t in kept if terms[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize(("block", "tile"), [(64, 256), (2, 3)])
def test_divergence(docs, rows, block, tile):
    for least, top in ((5, 50), (2, 3)):
        same(divergence.audit(docs, least, top, block, tile), divergence_by_definition(rows, least, top))


def test_divergence_of_light_terms_only(spark):
    """Each term is in at most two of many sources, so all sums come from histograms and posting lists."""
    rnd = random.Random(3)
    rows = [(i, " ".join(f"t{chr(97 + (i % 14) // 2)}{chr(97 + rnd.randint(0, 3))}" for _ in range(rnd.randint(0, 9))), "en", f"s{i % 14}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert not divergence.Shares(docs, 2).cells.where("heavy").count()
    same(divergence.audit(docs, 2), divergence_by_definition(rows, 2, 50))


def test_corrections_in_steps(monkeypatch):
    rnd = np.random.default_rng(2)
    starts = np.r_[0, np.cumsum(rnd.integers(1, 6, 40))]
    group = np.concatenate([rnd.permutation(9)[: b - a] for a, b in zip(starts, starts[1:], strict=False)])
    p, floor = rnd.integers(1, 10**9, len(group)), rnd.integers(1, 10**6, 9)[group]
    want = Counter()
    for a, b in zip(starts, starts[1:], strict=False):
        for i in range(a, b):
            for j in range(i + 1, b):
                key = tuple(sorted((int(group[i]), int(group[j]))))
                want[key] += int(abs(p[i] - p[j]) - abs(p[i] - floor[j]) - abs(floor[i] - p[j]) + abs(floor[i] - floor[j]))
    for most in (1 << 20, 3):
        monkeypatch.setattr(divergence, "MOST_PAIRS", most)
        low, high, sums = divergence.corrections(group, p, floor, starts)
        assert {(int(a), int(b)): int(v) for a, b, v in zip(low, high, sums, strict=True)} == want


def collocations_by_definition(rows, least, longest, covered, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(int(Fraction(10**6 * a * a, counts[p[:k]] * counts[p[k:]])), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize(("least", "longest", "covered", "top", "bits"), [(10, 3, 50, 2000, 1 << 28), (3, 3, 50, 7, 1 << 20), (2, 4, 30, 60, 1 << 18)])
def test_collocations(docs, rows, least, longest, covered, top, bits, monkeypatch):
    same(collocations.mine(docs, least, longest, covered, top, bits), collocations_by_definition(rows, least, longest, covered, top))


def test_a_full_bitmap_changes_nothing(docs, rows, monkeypatch):
    """With every bit set, each phrase is counted; those that are frequent are the same."""
    real = collocations.bitmap_of
    monkeypatch.setattr(collocations, "bitmap_of", lambda *a: collocations.Bitmap(np.full_like(real(*a).bits, 255)))
    same(collocations.mine(docs, 3), collocations_by_definition(rows, 3, 3, 50, 2000))


def test_bitmaps_hold_their_phrases(docs):
    words, pairs = collocations.levels(docs, 3)[0][:2]
    for table in (words, pairs):
        bitmap = collocations.bitmap_of(table)
        h = [[np.uint64(collocations.word_hash(w.encode(), r.lang)) for w in r.phrase.split(" ")] for r in table.collect()]
        found = np.array([x[0] if len(x) == 1 else collocations.joined_hash(np.array(x[:1]), np.array(x[1:]))[0] for x in h], np.uint64)
        assert len(found) and bitmap.has(found).all()
        assert not bitmap.has(np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).all()


@pytest.mark.parametrize("k", [1, 2, 3])
def test_runs_hold_each_phrase_once(k):
    rnd = random.Random(k)
    for _ in range(60):
        text = "".join(rnd.choice(["a", "bb", " ", " ", "  ", ".", "c" * rnd.randint(1, 30)]) for _ in range(80)).encode()
        grams = lambda t, k=k: Counter(tuple(w[i : i + k]) for piece in t.split(b".") for w in [piece.split()] for i in range(len(w) - k + 1))
        assert sum((grams(run) for run in collocations.runs(text, k, 25)), Counter()) == grams(text)


def test_counts_are_handed_on_in_parts(docs, rows, monkeypatch):
    for name in ("MOST_WORDS", "MOST_PHRASES", "RUN_BYTES"):
        monkeypatch.setattr(collocations, name, 40)
    for k in (1, 2, 3):
        every = collocations.Bitmap(np.full(1 << 10, 255, np.uint8))
        counts, found = collocations.Counts("en", k, every), Counter()
        text = ".".join(t for _, t, lang, *_ in rows if lang == "en" and t).encode().translate(collocations._FOLD)
        for run in [*collocations.runs(text, k, 100), None]:
            if run is not None:
                counts.add(run)
            if run is None or counts.full():
                for batch in counts.rows():
                    found.update(dict(zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist(), strict=True)))
                counts.clear()
        want = Counter(b" ".join(w[i : i + k]) for piece in text.split(b".") for w in [piece.split()] for i in range(len(w) - k + 1))
        total = found.pop(b"", 0)
        assert found == want and (k > 1 or total == sum(want.values()))


def assign_by_definition(lengths, capacity, linear):
    seqs = [[] for _ in range(sum(lengths) // capacity)]
    used = lambda s: sum(n for *_, n in s)
    cost = lambda s: sum(linear * n + n * n for *_, n in s)
    left = []
    for rest in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, length = 0, lengths[rest]
        while length:
            fits = [s for s in seqs if capacity - used(s) >= length] if not start else []
            to = min(fits or [s for s in seqs if used(s) < capacity], key=cost, default=None)
            if to is None:
                left.append((rest, start, length))
                break
            n = min(length, capacity - used(to))
            to.append((rest, start, n))
            start, length = start + n, length - n
    return [[tuple(x) for x in s] for s in seqs], left


def test_assignment():
    rnd = random.Random(8)
    for linear in (6144.0, 0.0):
        for n in (0, 1, 5, 60):
            lengths = [rnd.choice([1, 5, 31, 32, rnd.randint(1, 31), 7]) for _ in range(n)]
            placed, left = packing.assign(lengths, 32, linear)
            seqs = defaultdict(list)
            for rest, start, length, to, offset in placed:
                assert offset == sum(x[2] for x in seqs[to])
                seqs[to].append((rest, start, length))
            want, open_ = assign_by_definition(lengths, 32, linear)
            assert [seqs[i] for i in range(len(want))] == want and left == open_
            assert all(sum(x[2] for x in s) == 32 for s in seqs.values()) and sum(x[2] for x in left) < 32


def test_costs_are_balanced():
    rnd = random.Random(9)
    lengths = [rnd.randint(1, 1023) for _ in range(2000)]
    placed, _ = packing.assign(lengths, 1024)
    cost = Counter()
    for _, _, length, to, _ in placed:
        cost[to] += packing.attention_cost(length)
    first_fit, used = Counter(), []  # descending documents, each to the first sequence that has room
    for n in sorted(lengths, reverse=True):
        to = next((i for i, u in enumerate(used) if u + n <= 1024), len(used))
        used[to : to + 1] = [(used[to] if to < len(used) else 0) + n]
        first_fit[to] += packing.attention_cost(n)
    spread = lambda c: np.std(list(c.values())) / np.mean(list(c.values()))
    assert spread(cost) < spread(first_fit)


@pytest.mark.parametrize(("parts", "rests"), [(3, 8192), (7, 10)])
def test_packing(docs, rows, parts, rests, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_tokenizer())
    for capacity in (1024, 64):
        pieces = packing.pack(docs.repartition(parts), capacity=capacity)
        found = [r.asDict() for r in pieces.collect()]
        for r in found:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        by_sequence = defaultdict(list)
        for r in found:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for x in by_sequence.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= capacity
        assert sum(sum(n for _, n in x) < capacity for x in by_sequence.values()) <= 1  # one open sequence at most
        want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
        by_doc = defaultdict(list)
        for r in found:
            by_doc[r["doc_id"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]))
        for doc_id in {d for d, _ in want}:
            if sum(n for (d, _), n in want.items() if d == doc_id) == 1:  # rows of one id can't be told apart
                x = sorted(by_doc[doc_id])
                assert [s for s, _, _ in x] == [sum(len(i) for _, i, _ in x[:k]) for k in range(len(x))]
                ids = tuple(i for _, p, _ in x for i in p)
                assert (doc_id, ids) in want and all(n == len(ids) for *_, n in x)
        assert sum(len(i) for x in by_doc.values() for _, i, _ in x) == sum(len(ids) * n for (_, ids), n in want.items())


def test_open_pieces_fill_sequences(spark, monkeypatch):
    """Many tasks of one short document each: only the second pass makes full sequences."""
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(60)], "doc_id long, text string").repartition(30)
    lengths = [r.n for r in packing.pack(docs, capacity=64).groupBy("sequence_id").agg({"length": "sum"}).toDF("id", "n").collect()]
    assert sum(n < 64 for n in lengths) <= 1


def test_sequences(docs):
    pieces = packing.pack(docs, capacity=64)
    ids = {r.sequence_id: b"" for r in pieces.collect()}
    for r in sorted(pieces.collect(), key=lambda r: r.offset):
        ids[r.sequence_id] += r.ids
    for r in packing.sequences(pieces, 64, pad_id=7).collect():
        own = np.frombuffer(ids[r.sequence_id], "<u4").tolist()
        assert r.n_ids == len(own) == sum(r.piece_lengths) and len(r.piece_lengths) == len(r.doc_ids)
        assert r.ids == (own if len(own) & (len(own) - 1) == 0 else own + [7] * (64 - len(own)))


def test_empty_tables(docs):
    none = docs.where("doc_id < -1")
    for df in (divergence.audit(none), collocations.mine(none), packing.pack(none), packing.sequences(packing.pack(none))):
        assert df.collect() == []


def test_sql(spark, small):
    con = compare.connect(small)
    for name in ("op11_source_divergence", "op12_phrase_collocations"):
        assert compare.mismatch(queries.queries()[name](spark, small), con, queries.oracle_sql()[name]) == ""


def test_very_long_texts(spark):
    long = "lorem ipsum dolor, " * 300_000
    docs = spark.createDataFrame([(1, long, "la", "a"), (2, "lorem ipsum", "la", "b"), (3, "y" * 3_000_000 + " z", "la", "b")], "doc_id long, text string, lang string, source string")
    found = {r.phrase: (r.a, r.l, r.r) for r in collocations.mine(docs).collect()}
    assert found == {"lorem ipsum dolor": (300_000, 300_001, 300_000)} or found["lorem ipsum dolor"][0] == 300_000
    assert {(r.source, r.item) for r in divergence.audit(docs, 1).where("part = 'pair'").collect()} == {("a", "b"), ("b", "a")}
    assert packing.pack(docs.where("doc_id < 3")).selectExpr("max(offset + length)").first()[0] == 1024
