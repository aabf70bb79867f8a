"""SimHash, language ID, decontamination, personal data and packing against brute force and edge cases."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbisframe.llm import decontaminate, langid, packing, pii, simhash
from orbisframe.llm.graph import components
from orbisframe.llm.queries import QUERIES, tokenizer_path
from orbisframe.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Das ist ein sehr langer Text über Züge und Wege. " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7),
        (None, "one two", "en", "s", 7), (5, "   \n\t ", "en", "s", 5), (6, LONG, "de", "s", len(LONG)), (7, "12 34 !!", None, "s", 8),
    ]
    table = spark.createDataFrame(rows, DOCS)
    extra = {c: table.doc_id for c in ("fp", "key", "count", "score", "lang_pred", "salt", "rank", "item_id", "component_id", "length")}
    return table.withColumns(extra)


def plain_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: id -> fingerprint."""
    ids, root = sorted(fps), {i: i for i in fps}
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def test_simhash_matches_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op2_simhash_pivots"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)


def test_simhash_chains_and_hot_keys(spark):
    """Clouds of close fingerprints, cut into tiles far smaller than the cloud."""
    rng = random.Random(1)
    fps = {}
    for c in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            centre ^= 1 << rng.randrange(64) if rng.random() < 0.5 else 0
            f = centre
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
            fps[len(fps)] = f
    table = spark.createDataFrame([((f ^ 1 << 63) - (1 << 63),) for f in set(fps.values())], "fp long")
    scratch = Scratch(spark, "t")
    found = components(simhash.links(table, scratch, tile=5), scratch)
    got = {r.node % 2**64: r.root for r in found.collect()}
    want = plain_components(fps)
    groups = {}
    for i, f in fps.items():
        groups.setdefault(want[i], set()).add(f)
    for members in groups.values():
        assert len({got.get(f, f) for f in members}) == 1
    assert len({got.get(f, (f ^ 1 << 63) - (1 << 63)) for f in fps.values()}) == len(groups)


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 8
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1: 1, 2: 1, 5: 1}
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def plain_code_length(train, text):
    """Bits by the definition, byte by byte, over dictionaries."""
    alphabet = {b for parts in train.values() for p in parts for b in p.encode()}
    out = {}
    for lang, parts in train.items():
        counts = {}
        for p in parts:
            s = [0, 0, 0, *[b + 1 for b in p.encode()]]
            for i in range(3, len(s)):
                for o in range(4):
                    counts.setdefault(tuple(s[i - o : i]), {}).setdefault(s[i], 0)
                    counts[tuple(s[i - o : i])][s[i]] += 1
        symbols = [0, *sorted(b + 1 for b in alphabet), "other"]

        def probabilities(ctx, counts=counts, symbols=symbols):
            lower = probabilities(ctx[1:]) if ctx else {s: 1 / len(symbols) for s in symbols}
            seen = counts.get(ctx)
            if not seen:
                return lower
            n, d, left = sum(seen.values()), len(seen), sum(p for s, p in lower.items() if s not in seen)
            return {s: seen[s] / (n + d) if s in seen else d / (n + d) * lower[s] / left for s in symbols}

        s = [0, 0, 0, *[b + 1 if b in alphabet else "other" for b in text.encode()]]
        out[lang] = sum(-np.log2(probabilities(tuple(s[i - 3 : i]))[s[i]]) for i in range(3, len(s)))
    return out


def test_code_lengths_match_the_definition():
    train = {"aa": ["abab cab", "bca"], "bb": ["zab zzc", "cc"]}
    model = langid.fit(train)
    texts = ["abc zab", "bbb", "a?b!", "zz", "a"]
    got = model.code_lengths(texts)
    for t, row in zip(texts, got, strict=True):
        want = plain_code_length(train, t)
        assert row == pytest.approx([want[g] for g in model.langs], rel=1e-5)
    long = "abc zab " * 300_000
    assert model.code_lengths([long])[0] == pytest.approx(model.code_lengths(["abc zab " * 3000])[0] * 100, rel=1e-2)


def test_language_held_out_accuracy(spark):
    got = QUERIES["op8_ppm_language"](spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    both = got.merge(lang, on="doc_id")
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd):
    model = langid.learn(odd.withColumn("lang", odd.lang))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, model).collect()]
    assert len(got) == 8
    assert [(i, g, s) for i, g, s in got if i in (1, 2, 5, 7)] == [(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0), (7, "und", 0.0)]
    assert langid.accept(odd, model).columns == odd.columns
    nothing = langid.learn(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), nothing).count() == 0


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return row


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=80))
def test_myers_matches_the_table(pattern, text):
    assert decontaminate.myers(pattern, text) == plain_distance(pattern, text)


def test_decontamination_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng = random.Random(3)
    items = {r.item_id: r.text for r in bench.collect()}
    rows = [(r.doc_id, r.text[:1500]) for r in docs.limit(25).collect()]
    for n, (i, t) in enumerate(list(items.items())[:8]):
        k = int(0.05 * len(decontaminate.normalize(t))) + (n % 3 - 1)
        noisy = list(t)
        for _ in range(max(0, k)):
            noisy[rng.randrange(len(noisy))] = rng.choice("qxj")
        rows.append((1000 + n, "Xx yy. " + "".join(noisy) + " zz"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(table, bench, block_chars=900).collect()}
    want = {}
    for d, t in rows:
        text = decontaminate.normalize(t)
        for i, raw in items.items():
            item = decontaminate.normalize(raw)
            low = min(decontaminate.myers(item, text))
            if low <= int(0.05 * len(item)):
                want[d, i] = low
    assert got == want and len(got) > 4
    kept = decontaminate.decontaminate(table, bench, block_chars=900)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_spans_and_odd_rows(spark, odd):
    item = "the quick brown fox jumps over the lazy dog"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    text = "Say: The QUICK -- brown fox\njumps over the lazy dog! End"
    docs = spark.createDataFrame([(9, text), (9, text), (None, text)], "doc_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.distance, text[r.start : r.end]) for r in got] == [(d, 1, 0, text[5:-5]) for d in (9, 9, None)]
    assert decontaminate.contamination(odd, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench).count() == 8
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_short_items_match_whole_words(spark):
    bench = spark.createDataFrame([(1, "Forty-two!"), (2, "in Paris"), (3, "IN, paris"), (4, "?!")], "item_id long, text string")
    texts = ["It is: FORTY two, in  Paris", "forty twos in Parish", "fortytwo", "in Paris in Paris", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, texts[r.doc_id][r.start : r.end]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(0, 1, 0, "FORTY two"), (0, 2, 0, "in  Paris"), (0, 3, 0, "in  Paris"), (3, 2, 0, "in Paris"), (3, 3, 0, "in Paris")]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [1, 2, 4, 5]


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(1, *m.span())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(2, *m.span())] * (16 <= len(d) <= 19 and pii.luhn(d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(3, *m.span())] * (8 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return out


@settings(max_examples=500, deadline=None)
@given(st.text("0125.@a_ +()-9", max_size=60) | st.text("4 -", max_size=40))
def test_base_spans_match_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_spans(text))


def test_pii_query_matches_the_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op7_pii_weak_supervision"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = sorted(plain_spans(texts[r.doc_id]))
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in want) for j in range(4)]
        assert {x for x in said.split(",") if x} <= set(r.spans.split(","))


def test_pii_learns_proposed_spans(spark, odd):
    texts = [f"Please contact mail{i}@site{i}.com or call +1 (212) 555-{1000 + i}." for i in range(200)]
    texts += [f"Contact us by mail: joe{i} (at) site{i} (dot) com." for i in range(40)]
    texts += [f"version joe{i} at the{i} dot order" for i in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labeling = pii.learn(table)
    got = {r.doc_id: r for r in pii.detect(table, labeling).collect()}
    assert all(got[i].spans.startswith("email:") and got[i].n_email == 0 for i in range(200, 240))
    assert all(got[i].spans == "" for i in range(240, 280))
    assert all(got[i].n_email == 1 and got[i].n_phone == 1 for i in range(200))
    run_on = "+1 (569) 555-6633 4556737586899855 or"
    assert pii.base_spans(run_on) == [] and (3, 0, 17) in pii.find(run_on, labeling)[1]
    masked = {r.doc_id: r.text for r in pii.redact(table, labeling).collect()}
    assert masked[0] == "Please contact <EMAIL> or call <PHONE>."
    assert pii.detect(odd, pii.learn(odd)).count() == 8
    assert pii.redact(odd, labeling).columns == odd.columns
    assert pii.detect(odd.limit(0), pii.learn(odd.limit(0))).count() == 0
    assert pii.masked("ab+1 22.33.44.55", [(1, 6, 15), (3, 2, 12)]) == "ab<PHONE>5"


def test_pii_is_linear_in_spans():
    def took(n):
        text = "mail a@b.com or joe (at) site (dot) com, " * n
        began = time.perf_counter()
        assert len(pii.candidates(text)) == 2 * n
        return time.perf_counter() - began

    took(100)
    assert min(took(4000) for _ in range(3)) < 5 * min(took(2000) for _ in range(3)) + 0.05
    assert [s[:3] for s in pii.candidates("host abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd up")] == [(1, 5, 44)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_file(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, made = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["", None, "It's  a TEST, of words.\n\n  two\ttabs", "ab\u0301 \u0130stanbul \u00c9t\u00e9 x\u00a0y\u2003z", "<|endoftext|> a<|endoftext|>b", "  ", "caf\u00e9s, 12.5% (na\u00efve)!?", "\u4f60\u597d \U0001f600"]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert made.encode(texts) == want and made.encode(texts) == want
    assert made.apart == name.startswith("word")


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer, by_doc, by_sequence = Tokenizer.from_file(tokenizer_path()), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for d, parts in by_doc.items():
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        for p, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            own = ids[p * capacity : (p + 1) * capacity]
            assert (r.piece, r.start, r.length) == (p, p * capacity, len(own))
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        assert len(parts) == -(-len(ids) // capacity)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    used, least = check_packing(QUERIES["op6_pattern_packing"](spark, "/root/testdata/sf0.01").collect(), texts)
    assert used <= least * 1.02 + 1


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in rows) == 8
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0
    many = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "ab́ É x y", "<|endoftext|> x"] * 40)], "doc_id long, text string")
    check_packing(packing.pack(many, tokenizer_path()).collect(), {r.doc_id: r.text for r in many.collect()})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_plan_holds_every_piece(counts):
    histogram = np.zeros(65, dtype=np.int64)
    for length, n in counts.items():
        histogram[length] = n
    made = np.zeros(65, dtype=np.int64)
    for pattern, repeats in packing.plan(histogram, 64):
        assert repeats > 0 and sum(pattern) <= 64
        for length in pattern:
            made[length] += repeats
    assert (made == histogram).all()


def test_pipeline_matches_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    langs, scores = langid.predict(model, [r.text for r in docs.values()])
    kept = {i: r.text for (i, r), g, s in zip(docs.items(), langs, scores, strict=True) if g != "und" and s >= 0.5}
    roots = plain_components({i: plain_fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    items = [decontaminate.normalize(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, t in kept.items() if any(x in decontaminate.normalize(t) for x in items)}
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id for r in rows}
    assert got <= kept.keys() - leaks and len(kept.keys() - leaks - got) < 5
    table = spark.createDataFrame([(i, kept[i]) for i in got], "doc_id long, text string")
    labeling = pii.learn(table)
    masked = {i: pii.masked(kept[i], pii.find(kept[i], labeling)[1]) for i in got}
    check_packing(rows, masked)


def test_nfc_does_not_cross_spaces():
    assert unicodedata.normalize("NFC", "a ́b") == "a ́b"


def test_languages_of_long_texts_only_are_learned(spark):
    long = {"aa": "abra kadabra alakazam " * 5_000, "bb": "wozu denn wohin woher " * 5_000}
    rows = [(i, long["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb") for i in range(12)]
    rows += [(100 + i, "ni hao ma ni hao", "cc") for i in range(9)] + [(None, f"null id {i} null id", "dd") for i in range(50)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), span=300)
    assert model.langs == ["aa", "bb", "cc", "dd"]
    assert langid.predict(model, ["kadabra abra", "wohin denn", "ni hao", "²½ 12", "null id"])[0] == ["aa", "bb", "cc", "und", "dd"]
    with pytest.raises(ValueError):
        langid.MAX_LANGS, kept = 3, langid.MAX_LANGS
        try:
            langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        finally:
            langid.MAX_LANGS = kept


def test_model_stays_small_for_many_languages():
    rng = random.Random(5)
    texts = {}
    for n in range(40):
        letters = [chr(rng.randrange(0x4E00 + 40 * n, 0x4E40 + 40 * n)) for _ in range(30)]
        texts[f"l{n:02}"] = [" ".join("".join(rng.choices(letters, k=5)) for _ in range(300)) for _ in range(3)]
    model = langid.fit(texts)
    entries = sum(len(a) for t in model.trees for a in [*t.grams, *t.contexts])
    total = sum(len(t.encode()) for ts in texts.values() for t in ts)
    assert entries <= 2 * (langid.ORDER + 1) * total
    assert langid.predict(model, [ts[0][:200] for _, ts in sorted(texts.items())])[0] == sorted(texts)


def test_keep_one_by_row(spark, monkeypatch):
    """Repeated ids, null ids, repeated rows and odd column names."""
    text = {n: f"document {n} " + " ".join(f"w{n}x{k}" for k in range(30)) for n in range(9)}
    rows = [
        (1, text[0], "a"), (1, text[1], "b"), (2, text[0], "c"),  # id 1 has a group of its own and another text
        (None, text[2], "d"), (None, text[2], "e"), (None, text[3], "f"), (5, text[3], "g"),
        (6, text[4], "h"), (6, text[4], "h"), (6, text[4], "a"), (7, None, "i"), (8, "", "j"), (None, "  ", "k"), (9, text[5], None),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "map('a', 1) as same", "2 as root")
    want = [(1, text[0], "a"), (1, text[1], "b"), (None, text[2], "d"), (5, text[3], "g"), (6, text[4], "a"), (7, None, "i"), (9, text[5], None)]
    key = lambda r: (str(r[0]), str(r[1]))
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text, r.fp) for r in kept.collect()), key=key) == sorted(want, key=key)
    assert simhash.keep_one(table.limit(0)).count() == 0
    plain = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()}
    monkeypatch.setattr(simhash, "HOT", 6)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()} == plain


def test_decontamination_places_match_brute_force(spark):
    """Distance and place of each item by the whole table of distances, and very long items and texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(8, 20))) for i in range(12)}
    texts = {}
    for d in range(40):
        parts = [rng.choice(words) for _ in range(30)]
        if d % 2:
            noisy = list(items[d % 12])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(noisy))
                noisy[at : at + 1] = rng.choice([[], ["z"], [noisy[at], "z"]])
            parts[10:10] = ["".join(noisy)]
        texts[d] = " ".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontaminate.contamination(docs, bench).collect()}
    want = {}
    for d, text in texts.items():
        for i, item in items.items():
            scores = plain_distance(item, text)
            low = min(scores)
            if low <= int(0.05 * len(item)):
                want[d, i] = (low, scores.index(low))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 10
    for (d, i), (_, start, end) in got.items():
        low, stop = want[d, i]
        assert min(plain_distance(items[i], texts[d][start:end])) == low and start < stop <= end < stop + 5
        assert (start == 0 or texts[d][start - 1] == " ") and (end == len(texts[d]) or texts[d][end] == " ")
    long = " ".join(f"item{k}" for k in range(4000))
    rows = [(1, "x " * 200_000 + long.replace("item77 ", "it77 ") + " y" * 200_000), (2, "x " * 500_000)]
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.distance, r.start) for r in found] == [(1, 2, 400_000)]
