"""Every operator on documents against a brute-force version, over awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import bytescan, license_scan, mixing, near_dup, packing, pii, quality, suffix_dedup, suffix_groups, token_codes, toxicity
from inkgrid.llm.suffix_groups import suffix_arrays
from inkgrid.llm.tokens import Encoder, default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("aeioustrnl", k=rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(5, 160))
        lines = [" ".join(words[j : j + 12]) for j in range(0, len(words), 12)]
        texts.append("\n".join(lines))
    for i in range(12):  # near copies
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], "", None, "   ", "one", "é à ü " * 30, "x" * 300, "ab" * 200, "word " * 4000]
    texts += ["Mail Bob.Smith+x@mail5.example.com or +1 (743) 555-3824, ip 227.5.221.1, bad 300.1.1.1, card 4111 1111 1111 1111."]
    texts += ["Released under the MIT License.\nplain line", "Licensed under CC BY-NC 4.0.", "General  Public\nLicense, MIT license", "All rights are reserved, all of the rights"]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k") for i, t in enumerate(texts)]
    return [*rows, (5, texts[8], "en", "s", 1, 0.1, "k"), (None, texts[9], None, None, None, None, None), rows[7]]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def got(df, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def want(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_quality_rules(docs, labels, none):
    def rules(text):
        t = text or ""
        words = WORD.findall(t)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        marked = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 1000 else set(range(len(words)))
        lines = [line for line in t.split("\n") if WORD.search(line)]
        n = len(words)
        return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n

    out = quality.quality_rules(docs, labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, *columns) == want([(r[0], *rules(r[1])) for r in ROWS])
    assert out.where("kept and base_failed").count() == 0 and out.where("quality is null or quality < 0 or quality > 1").count() == 0
    assert quality.quality_rules(none, labels).count() == 0


def test_quality_verdicts_and_calibration(spark):
    """On rows outside the fit the verdict follows the label, and scores are as sure as they are right, in any script."""
    rng = random.Random(14)
    good, bad, both = (["".join(rng.choices(a, k=6)) for _ in range(150)] for a in ("aeioustrnl", "éèñüßçаб", "mnopqr"))
    rows, marks = [], []
    for i in range(900):
        y = i % 3 > 0
        own = 0.35 if rng.random() < 0.9 else 0.0  # some rows look like neither
        words = [rng.choice((good if y else bad) if rng.random() < own else both) for _ in range(60)]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(y)))
    known = spark.createDataFrame(marks[:600], "doc_id long, quality int")
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, quality string"), known).where("doc_id >= 600").collect()
    assert sum(r["kept"] == bool(marks[r["doc_id"]][1]) for r in out) > 0.9 * len(out)
    for low, high in ((0, 0.5), (0.5, 0.8), (0.8, 1.01)):
        own = [r for r in out if low <= r["quality"] < high]
        if len(own) > 20:
            assert abs(np.mean([r["quality"] for r in own]) - np.mean([marks[r["doc_id"]][1] for r in own])) < 0.15


def test_character_grams():
    """Grams are of four characters, whatever their bytes."""
    import pyarrow as pa

    from inkgrid.llm.bytescan import chunks
    from inkgrid.llm.features import word_and_char_grams

    texts = ["abcde", "яяяяя", "яяяя", "abc", "", "xabcd", "a😀bя😀a😀bя"]
    (chunk,) = chunks(pa.array(texts))
    rows, buckets = word_and_char_grams(chunk, 16)[2]
    assert np.bincount(rows, minlength=len(texts)).tolist() == [max(0, len(t) - 3) for t in texts]
    of = lambda i: buckets[rows == i].tolist()
    assert of(5)[1] == of(0)[0] and set(of(1)) == set(of(2)) and of(6)[0] == of(6)[5]


def test_terms_and_stems():
    """Distinct words, and one term more for each of the first words of a stem."""
    import pyarrow as pa

    from inkgrid.llm.bytescan import chunks
    from inkgrid.llm.features import TELL, distinct_terms

    texts = ["Run runs running", "Überfall überfälle", "abcdef abcdeg abcdeh abcdei abcdej abcdek abcdef", "", "abcdex", "ABCDEX abcde"]
    (chunk,) = chunks(pa.array(texts))
    rows, buckets = distinct_terms(chunk, 30)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [4, 4, 6 + TELL, 0, 2, 3]
    own = lambda i: set(buckets[rows == i].tolist())
    assert len(own(4) & own(2)) == 1 and len(own(4) & own(5)) == 2


def test_toxicity(docs, spark, none, labels):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("aeioustrnl", k=5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = rng.choices(vocab, k=40) + (rng.sample(["Scum,", "idiot.", "trash", "moron"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity(table, known).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 150 and sum((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in held) > 0.97 * len(held)
    assert toxicity.remove_toxic(table, known).count() == sum(r["predicted"] == 0 for r in scored)
    odd = toxicity.toxicity(docs, labels)
    assert odd.count() == len(ROWS) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.remove_toxic(docs, labels).columns == docs.columns


def test_pairs_outweigh_sums(spark):
    """Neither term alone is toxic, both together are: only products of factors can tell."""
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(800):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "rho"], k=6)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["insult"] * a + ["group"] * b)))
        marks.append((i, 1, int(a and b)))
    scored = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert sum(r["predicted"] == marks[r["doc_id"]][2] for r in scored) > 0.95 * len(rows)


def test_pairs_of_neutral_terms(spark):
    """A group mention as common in clean as in toxic texts decides what an insult means; then two terms that lean nowhere at all."""
    rng = random.Random(5)
    rows, marks, mixed = [], [], []
    for i in range(900):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "rho"], k=6)
        t = rng.random()
        a, b, other = (1, 1, 0) if t < 0.2 else (1, 0, 0) if t < 0.35 else (0, 1, 0) if t < 0.65 else (0, 0, 1) if t < 0.85 else (0, 0, 0)
        rows.append((i, " ".join(words + ["insult"] * a + ["group"] * b + ["scum"] * other)))
        marks.append((i, 1, int(a and b or other)))
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        mixed.append((i, " ".join(rng.choices(["alpha", "beta", "rho"], k=5) + [["praise", "insult"][a], ["tool", "group"][b]]), int(a == b)))
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert sum(r["predicted"] == marks[r["doc_id"]][2] for r in scored) > 0.95 * len(rows)
    known = spark.createDataFrame([(i, 1, y) for i, _, y in mixed], "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity(spark.createDataFrame([x[:2] for x in mixed], "doc_id long, text string"), known).collect()
    assert sum(r["predicted"] == mixed[r["doc_id"]][2] for r in scored) > 0.95 * len(mixed)


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    out = token_codes.read_token_files(token_codes.write_token_files(docs, shard_tokens=500))
    assert got(out, "doc_id", "n_tokens", "ids_crc32") == want([(r[0], len(ids(r[1])), zlib.crc32(ids(r[1]))) for r in ROWS])
    rows = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    real = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert real == sorted(real)
    assert token_codes.read_token_files(token_codes.write_token_files(none)).count() == 0


def test_single_tokens(docs, spark):
    """Tokens by random access equal those of whole documents; what is not there gives no row."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    files = token_codes.write_token_files(docs, shard_tokens=300)
    texts = {r[0]: r[1] for r in ROWS if r[0] not in (5, 7, None)}
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    asked = [(d, p) for d in ids for p in range(0, len(ids[d]), 37)] + [(3, 10**6), (999, 0), (None, 0), (3, -1)]
    found = token_codes.tokens_at(files, spark.createDataFrame(asked, "doc_id long, position long"))
    assert got(found, "doc_id", "position", "token_id") == want([(d, p, ids[d][p]) for d, p in asked if d in ids and 0 <= p < len(ids[d])])


def test_single_tokens_read_few_files(spark, monkeypatch):
    """One token's files are named to the scan; with more files than may be named the join finds them; both give the same."""
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * 400) for i in range(400)], "doc_id long, text string")
    files = token_codes.write_token_files(docs, shard_tokens=800)
    one = spark.createDataFrame([(77, 5)], "doc_id long, position long")
    some = spark.createDataFrame([(d, 5) for d in range(0, 400, 9)], "doc_id long, position long")
    scans = [line for line in token_codes.tokens_at(files, one)._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line and "codes" in line]
    assert scans and all("EqualTo(part" in line and "EqualTo(number" in line for line in scans)
    named = got(token_codes.tokens_at(files, some), "doc_id", "position", "token_id")
    monkeypatch.setattr(token_codes, "MAX_NAMED", 3)
    assert got(token_codes.tokens_at(files, some), "doc_id", "position", "token_id") == named and len(named) == 45
    assert token_codes.tokens_at(files, one.limit(0)).count() == 0


def test_features_are_bounded_by_bytes(spark):
    """Of very long labelled texts as many take part as fit, in the order of the ids' hashes."""
    from inkgrid.llm.features import distinct_terms, labelled_features

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50 * (1 + i % 3)))) for i in range(60)] + [(3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    size = lambda out: sum(8 * len(x) for _, tables in out for x, _ in tables)
    whole = labelled_features(docs, chosen, lambda c: [distinct_terms(c, 18)])
    assert len(whole) == 60
    few = labelled_features(docs, chosen, lambda c: [distinct_terms(c, 18)], size(whole) // 2)
    assert 0.3 * size(whole) < size(few) <= size(whole) // 2
    assert labelled_features(docs, chosen, lambda c: [distinct_terms(c, 18)], 10) == []


def test_special_tokens_in_texts(spark):
    """Markers within texts get the ids that the library gives, in token files and in packed sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c", "plain  text ", "x <|endoftext|><|endoftext|> y <|endo", None]
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = token_codes.read_token_files(token_codes.write_token_files(table))
    assert got(out, "doc_id", "n_tokens", "ids_crc32") == [(i, len(x), zlib.crc32(x)) for i, x in enumerate(ids)]
    assert got(packing.pack(table), "doc_id", "length", "ids_crc32") == [(i, len(x), zlib.crc32(x)) for i, x in enumerate(ids)]


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.array([0]), rng.integers(0, 50257, 3000), rng.integers(0, 1 << 31, 777), np.full(1025, 255), np.zeros(0, int)):
        codes = token_codes.Codes.open(token_codes.encode_codes(ids))
        assert codes.all().tolist() == ids.tolist()
        assert all(codes[i] == ids[i] for i in range(0, len(ids), 7))


def test_encoder_cuts():
    encoder = Encoder(default_tokenizer())
    texts = ["", " ", "a  b", "a \n b", " lead", "trail ", "it 's don't", "<|endoftext|> a", "\x1c a \x1f b", "é à  \t ñ", "日本 語　b", "a  b"]
    full = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == full


def test_packing(docs, none):
    pieces = packing.pack(docs).collect()
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for number, own in by.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.concatenate([[0], np.cumsum([p["length"] for p in own])])[:-1].tolist()
        assert sum(p["length"] for p in own) == 1024 or number == max(by)
    whole = token_codes.read_token_files(token_codes.write_token_files(docs))
    assert sum(p["length"] for p in pieces) == whole.agg(F.sum("n_tokens")).first()[0]
    encoder = Encoder(default_tokenizer())
    texts = {r[0]: r[1] for r in ROWS if r[0] not in (5, 7, None)}
    ids = {k: np.append(encoder.encode([t or ""])[0], 0).astype("<u4") for k, t in texts.items()}
    assert all(zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for p in pieces if p["doc_id"] in ids)
    assert packing.pack(none).count() == 0


def shingles(text, size):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, none, size):
    real = [r for r in ROWS if r[0] is not None]
    sets = [(r[0], shingles(r[1], size)) for r in real]
    parent = {d: d for d, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    out = near_dup.near_duplicates(docs, size).where("doc_id is not null")
    assert got(out, "doc_id", "n_shingles", "component_id") == want([(d, len(s), find(d)) for d, s in sets])
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.drop_near_duplicates(docs, size)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {find(d) for d, _ in sets} | {None}


def test_dense_family(spark):
    """Hundreds of variants of one text, some beyond the threshold: components as by brute force, in large and small nodes."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 9])):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 2) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for large in (2000, 70):
        assert got(near_dup.near_duplicates(table, 2, large=large), "doc_id", "component_id") == [(i, c) for i, c in enumerate(label)]
    # Nodes that meet in parts, of which some are dense and some branch.
    for large, local in ((2000, 10), (70, 40)):
        assert got(near_dup.near_duplicates(table.repartition(6), 2, large=large, local=local), "doc_id", "component_id") == [(i, c) for i, c in enumerate(label)]


def test_one_id_with_different_texts(spark):
    """Rows of one id stay if their texts differ; equal rows stay once; columns may have any name."""
    rows = [(1, "a b c d e f g", 1), (1, "h i j k l m n", 2), (1, "a b c d e f g", 3), (2, "o p q r s t u", 4), (3, "o p q r s t u", 5), (None, "x", 6), (None, "x", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, place long")
    kept = near_dup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert got(kept, "doc_id", "text") == want([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u"), (None, "x"), (None, "x")])


def test_rows_of_one_id_go_by_their_own_texts(spark):
    """An unlike text stays though another row of its id is a copy, and a copy goes though another row of its id stays."""
    words = [f"w{i}" for i in range(60)]
    text, near, unlike = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"u{i}" for i in range(60))
    for copy in (near, text):
        table = spark.createDataFrame([(3, text), (5, copy), (5, unlike), (5, unlike), (4, None), (4, ""), (6, "x y"), (6, "x y z")], "doc_id long, text string")
        assert got(near_dup.drop_near_duplicates(table), "doc_id", "text") == want([(3, text), (5, unlike), (4, None), (4, ""), (6, "x y"), (6, "x y z")])


def brute_licenses(text, notices):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", t)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = set(), 0.0
    for label, notice in notices:
        terms = set(notice.split())
        needed = -(-8 * len(terms) // 10)
        rivals = [terms - set(x.split()) for other, x in notices if other != label and len(terms & set(x.split())) >= needed]
        span = -(-3 * len(notice.split()) // 2)
        for i in range(len(words)):
            held = set(words[i : i + span]) & terms
            if len(held) >= needed and all(held & own for own in rivals if own):
                labels.add(label)
                best = max(best, len(held) / len(terms))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else best


LICENSE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_license_scan(docs, none):
    assert got(license_scan.license_scan(docs), *LICENSE_COLUMNS) == want([(r[0], *brute_licenses(r[1], license_scan.NOTICES)) for r in ROWS])
    assert license_scan.license_scan(none).count() == 0


def test_wrapped_and_rival_notices(spark):
    """Notices over several lines and in the midst of long lines; words too far apart; labels that exclude each other; a table of notices."""
    rng = random.Random(9)
    fill = lambda n: rng.choices(["of", "the", "and", "is", "licensed", "w1", "w2", "rights"], k=n)
    texts = []
    for _, notice in license_scan.NOTICES:
        words = notice.split()
        texts.append(" ".join(fill(30)) + "\n# " + "\n# ".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5)) + "\n" + " ".join(fill(9)))
        for drop in (1, len(words) // 5, len(words) // 3):
            left = list(words)
            for _ in range(drop):
                left[rng.randrange(len(left))] = "other"
            texts.append(" ".join(fill(40) + left + fill(40)))
        texts.append((" " + " ".join(fill(8)) + " ").join(words))
    texts += ["Licensed under CC BY-NC 4.0.", "licensed under cc by 4 0", "Licensed under CC BY-NC-SA 4.0", "ALL rights\nreserved", "all of the rights that were reserved"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = got(license_scan.license_scan(table), *LICENSE_COLUMNS)
    assert found == [(i, *brute_licenses(t, license_scan.NOTICES)) for i, t in enumerate(texts)]
    assert [r[6] for r in found[-5:]] == ["cc-by-nc", "", "cc-by-nc,cc-by-sa", "proprietary", ""]
    assert all(label in found[5 * i][6].split(",") for i, (label, _) in enumerate(license_scan.NOTICES))
    own = [("one", "alpha beta gamma delta epsilon"), ("two", "alpha beta gamma delta zeta"), ("none", "!!")]
    texts = ["Alpha beta gamma\ndelta", "alpha beta gamma delta zeta", "beta gamma delta epsilon", "alpha " * 50 + "gamma delta zeta", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    notices = spark.createDataFrame([*own, (None, "x"), ("y", None)], "label string, text string")
    assert got(license_scan.license_scan(table, notices), *LICENSE_COLUMNS) == [(i, *brute_licenses(t, own[:2])) for i, t in enumerate(texts)]
    assert got(license_scan.license_scan(table, notices.limit(0)), "labels") == [("",)] * 5


def test_many_and_long_notices(spark):
    """Hundreds of notices of usual words, whole license texts among them, as a table: as by brute force, repeated words and blocks of notices included."""
    rng = random.Random(33)
    vocab = [f"w{i}" for i in range(120)]
    notices = [(f"l{i % 9}", " ".join(rng.choices(vocab, k=rng.randint(1, 25)))) for i in range(300)]
    notices += [(f"long{i}", " ".join(rng.choices(vocab + [f"own{i}x{j}" for j in range(60)], k=400))) for i in range(3)]
    texts = []
    for _, notice in notices[::4] + notices[-3:]:
        words = notice.split()
        for _ in range(len(words) // 6):
            words[rng.randrange(len(words))] = rng.choice(["other", *vocab])
        texts.append(" ".join(rng.choices(vocab, k=rng.randint(0, 30)) + words + rng.choices(vocab, k=rng.randint(0, 30))))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert license_scan.NOTICE_BLOCK < len(notices)
    found = got(license_scan.license_scan(table, spark.createDataFrame(notices, "label string, text string")), *LICENSE_COLUMNS)
    assert found == [(i, *brute_licenses(t, notices)) for i, t in enumerate(texts)]
    assert sum("long" in row[6] for row in found) >= 3
    # Batches in which nothing of any notice stands, or too little of it.
    bare = [(0, None), (1, ""), (2, "nothing of them"), (3, "rights")]
    for row in bare:
        alone = spark.createDataFrame([row], "doc_id long, text string")
        assert got(license_scan.license_scan(alone), *LICENSE_COLUMNS) == [(row[0], *brute_licenses(row[1], license_scan.NOTICES))]


def test_base_patterns_in_linear_time():
    """The scans equal the patterns, and long runs cost time in proportion."""
    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choices("ab1.2@-+ (9%", k=rng.randint(0, 40)))
        spans = [(k, *m.span()) for k in pii.KINDS for m in pii.PATTERNS[k].finditer(text) if pii._valid(k, m[0])]
        assert pii.base_spans(text) == spans, text
    began = time.time()
    for text in ("1" * 10**6, "a" * 10**6 + " x@y", "@" + "a" * 10**6, "1." * 500_000, "+1" + "(" * 10**6, "'" + "a" * 10**6, "@a" * 400_000, "a@" * 400_000):
        pii.base_spans(text), pii.secret_spans(text)
    assert time.time() - began < 10


def brute_disclosures(texts):
    """Terms and their largest disclosure, straight from the definition."""
    word, n = re.compile("[0-9A-Za-z\x80-\U0010ffff]+"), len(texts)
    holders, counts, supports, both = {}, {}, {}, {}
    for i, text in enumerate(texts):
        spans = pii.base_spans(text) + pii.secret_spans(text)
        values, classes = pii.entities(text, spans)
        every = [(m[0].translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in word.finditer(text)]
        free = [x for x in every if not any(x[1] < b and x[2] > a for _, a, b in spans)]
        for t in {x[0] for x in every}:
            counts[t] = counts.get(t, 0) + 1
        for e in [*values, *classes]:
            holders[e] = holders.get(e, 0) + 1
            for t in {x[0] for x in free}:
                both[e, t] = both.get((e, t), 0) + 1
                if e in classes:
                    supports.setdefault((e, t), set()).update(classes[e])
                    continue
                a, b = values[e]
                near = [x[0] for x in free if x[2] <= a][-pii.CONTEXT :], [x[0] for x in free if x[1] >= b][: pii.CONTEXT]
                k = next(j for j, x in enumerate(every) if x[0] == t and x in free)
                around = [x[0] for x in every[max(0, k - pii.CONTEXT) : k]], [x[0] for x in every[k + 1 : k + 1 + pii.CONTEXT]]
                supports.setdefault((e, t), set()).add(str((near, around)))
    out = {}
    for (e, t), m in both.items():
        if len(supports[e, t]) >= (pii.MIN_VALUES if e & 1 else pii.MIN_CONTEXTS) and holders[e] < n:
            share = np.log(n * m / (counts[t] * holders[e])) / np.log(n / holders[e])
            if share >= pii.GENERALISE_AT:
                out[t] = max(out.get(t, 0), share)
    return out


def test_disclosures_of_classes(spark):
    """Names beside domains, areas and secrets, and copies that prove nothing: terms and shares as by brute force."""
    rng = random.Random(12)
    vocab = [f"common{i}" for i in range(60)]
    texts = []
    for i in range(300):
        words = rng.choices(vocab, k=20)
        if i % 10 == 0:
            words.insert(rng.randrange(20), f"Zaphod writes from u{i}@betel{i % 30 // 10}.example.com")
        if i % 12 == 1:
            words.insert(rng.randrange(20), f'token = "{rng.randrange(10**30):030d}abcdef"')
        if i % 15 == 2:
            words.insert(rng.randrange(20), f"Marvin +1 (743) 555-{i:04d}" + " secretly" * (i % 30 == 2))
        if i % 25 == 3:
            words[:] = ["copied", "line", "of", "copy@copies.example.com", "and", "unique"] * 3
        texts.append(" ".join(words))
    expected = brute_disclosures(texts)
    assert {"zaphod", "token", "marvin"} <= set(expected) and "unique" not in expected
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r["disclosure"] for r in pii.disclosures(table).collect()) == pytest.approx(sorted(expected.values()))
    flagged = {}
    for r in pii.find_personal_data(table).collect():
        for s in r["spans"].split(","):
            if s:
                kind, a, b = s.split(":")
                flagged.setdefault(kind, set()).add(texts[r["doc_id"]][int(a) : int(b)].lower())
    assert flagged.get("term", set()) | flagged.get("general", set()) == set(expected)
    assert flagged["term"] == {t for t, share in expected.items() if share >= pii.REMOVE_AT} and len(flagged["secret"]) > 10


def test_lists_of_values_in_copied_texts(spark):
    """Lists of recurring addresses: those of one profile stand for each other, with the disclosures of brute force."""
    rng = random.Random(21)
    vocab = [f"common{i}" for i in range(50)]
    texts = [" ".join(rng.choices(vocab, k=15)) for _ in range(60)] + [f"mail of a{i}@other{i}.example.org" for i in range(4)]
    # All three lists hold addresses 0 to 59; 60 to 79 are in the first and third as well as in three short texts, with one neighbour or several.
    for k in range(3):
        listed = [f"u{i}@d{i}.example.com" for i in range(80) if i < 60 or k != 1]
        texts.append(" ".join(f"row{i} {x} of{k if i % 3 else 0}" for i, x in enumerate(listed)) + " zaphod roster")
    for k in range(3):
        texts.append(" ".join(f"{'beside' if i % 2 else f'near{k}'} u{i}@d{i}.example.com trillian{i % 4}" for i in range(60, 80)))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    expected = brute_disclosures(texts)
    assert {"zaphod", "roster", "trillian1"} <= set(expected)
    assert sorted(r["disclosure"] for r in pii.disclosures(table).collect()) == pytest.approx(sorted(expected.values()))


def test_long_lists_of_values(spark):
    """Three texts of 10,000 recurring addresses end soon: their values and terms are not all paired."""
    listed = [f"row{i} u{i}@d{i}.example.com" for i in range(10_000)]
    texts = [f"plain text {i}" for i in range(20)] + [f"mail of a{i}@other{i}.example.org" for i in range(4)]
    texts += [f"list{k} " + " ".join(listed) for k in range(3)]
    begun = time.time()
    found = pii.disclosures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    took = time.time() - begun
    # Each row's name discloses its addresses, and each list's name that addresses stand there (five values or more).
    assert len(found) == 10_003 and [r["disclosure"] for r in found] == pytest.approx([1.0] * 10_003) and took < 60, took


def test_disclosures_on_the_tables(spark):
    """On the given documents terms are found too, the same as by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = brute_disclosures([r[0] or "" for r in docs.select("text").collect()])
    assert sorted(r["disclosure"] for r in pii.disclosures(docs).collect()) == pytest.approx(sorted(expected.values()))


def test_sanitise_with_clashing_columns(spark, monkeypatch):
    """Columns of any name stay as they are, whether terms are broadcast or shuffled."""
    rng = random.Random(13)
    rows = [(i, " ".join([*rng.choices([f"w{j}" for j in range(40)], k=20), *(["Zaphod", f"'{'ab1' * 8}{i}'", "z@betel.example.com"] if i % 20 == 0 else [])]), f"k{i}", f"m{i}", f"x{i}", i) for i in range(200)] + [(None, None, "k", "m", "x", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string, more string, term_spans string, __more int")
    first = pii.sanitise(table)
    clean = got(first, *table.columns)
    monkeypatch.setattr(pii, "MAX_BROADCAST_TERMS", 0)
    second = pii.sanitise(table)
    assert first.columns == second.columns == table.columns and got(second, *table.columns) == clean
    assert [(r[0], *r[2:]) for r in clean] == [(r[0], *r[2:]) for r in want(rows)]
    assert all("Zaphod" not in r[1] and "[EMAIL]" in r[1] and "[SECRET]" in r[1] for r in clean if r[0] is not None and r[0] % 20 == 0)
    assert pii.generalised("1987") == "[1980s]" and pii.generalised("4711") == "[NUMBER OF 4 DIGITS]" and pii.generalised("Zaphod") == "[NAME]"


def test_disclosing_terms(spark):
    rng = random.Random(3)
    vocab = [f"common{i}" for i in range(40)]
    rows = []
    for i in range(400):
        words = rng.choices(vocab, k=30)
        if i % 40 == 0:
            words[10:10] = ["Zaphod", "reach", "me", "z@betel.example.com", "now"]
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.find_personal_data(table).collect()
    flagged = {rows[r["doc_id"]][1][int(s.split(":")[1]) : int(s.split(":")[2])] for r in spans for s in r["spans"].split(",") if s.startswith("term")}
    assert flagged == {"Zaphod", "reach", "me", "now"}
    limit, pii.MAX_BROADCAST_TERMS = pii.MAX_BROADCAST_TERMS, 0
    try:
        assert sorted(map(str, pii.find_personal_data(table).collect())) == sorted(map(str, spans))
    finally:
        pii.MAX_BROADCAST_TERMS = limit


def test_disclosure_over_whole_documents(spark):
    """A name far from the address, one after a run of 200 ideographs, and one beside a long word all disclose it."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        fill = lambda n: " ".join(f"common{rng.randrange(40)}" for _ in range(n))
        text = fill(30)
        if i % 30 == 0:
            text = f"Zaphod {fill(40)} " + "\u4e2d" * (200 + i) + f" z@betel.example.com {'x' * (300 + i)} Trillian {fill(20)} Marvin"
        rows.append((i, text))
    spans = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    flagged = {rows[r["doc_id"]][1][int(s.split(":")[1]) : int(s.split(":")[2])] for r in spans for s in r["spans"].split(",") if s.startswith("term")}
    assert flagged == {"Zaphod", "Trillian", "Marvin"}


def test_mixing(docs, none, labels):
    out = mixing.mixing_rates(docs, labels, {"low": 0.4, "high": 0.6})
    t = out.agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col("p_low")), F.sum(F.col("n_tokens") * F.col("rate"))).first()
    assert out.count() == len(ROWS) and t[0] / t[1] == pytest.approx(0.4, abs=1e-3)
    many = mixing.mixed(docs, labels, {"low": 0.4, "high": 0.6})
    assert many.columns == docs.columns and many.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.mixing_rates(none, labels).count() == 0


def test_projected_rates_reach_targets():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.2, 0.2, 0.2], 500)
    n = rng.integers(1, 900, 500).astype(float)
    moment = (p * n[:, None]).T @ p
    goal = mixing.cover([0.2, 0.3, 0.5])(n @ p, moment)
    steps = []
    for _ in range(20):
        steps.append(np.linalg.pinv(moment) @ ((mixing.rates(p, steps) * n) @ p - goal))
    r = mixing.rates(p, steps)
    assert np.allclose((r * n) @ p, goal, rtol=1e-6) and r.min() >= 1


def test_projection_binds(spark):
    """Rates by brute force where the projection binds: at a floor of 1 below the covering total, and at 0 with a domain unwanted."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.05, 0.05, 0.05], 400)
    n = rng.integers(1, 900, 400)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(3)
    total, moment = n @ p, (p * n[:, None]).T @ p
    w = np.array([0.2, 0.3, 0.5])
    least, most = max(total / w), mixing.cover(w)(total, moment).sum()
    for goal, floor in ((w * (least + most) / 2, 1.0), (np.array([0.0, 0.5, 0.5]) * total.sum() * 0.9, 0.0)):
        steps, away = mixing.fit_rates(table, goal, floor)
        r, was = np.ones(len(p)), np.inf
        for k in range(len(steps)):
            away_, free = np.abs((r * n) @ p - goal).max(), r > floor
            scale = moment if not k or away_ > mixing.LITTLE * was else (p[free] * n[free, None]).T @ p[free]
            was, r = away_, np.maximum(floor, r - p @ (np.linalg.pinv(scale) @ ((r * n) @ p - goal)))
        assert np.allclose(mixing.rates(p, steps, floor), r) and (r <= floor).sum() > 50
        assert away == pytest.approx(np.abs((r * n) @ p - goal).max() / goal.sum()) and away < 0.02


def test_mixing_of_other_domains(spark):
    """Domains of the caller's naming, tokens of a tokenizer: every document stays, shares meet the weights."""
    rng = random.Random(3)
    vocab = {d: [f"{d}{i}" for i in range(30)] for d in ("law", "news", "code")}
    rows = [(i, " ".join(rng.choices(vocab[("law", "news", "code")[i % 3]], k=20 + i % 40)), i % 3) for i in range(300)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], ["law", "news", "code"][r[2]]) for r in rows[:200]], "doc_id long, area string")
    weights = {"law": 0.2, "news": 0.5, "code": 0.3}
    out = mixing.mixing_rates(table, known, weights, F.col("area"), tokenizer=default_tokenizer()).toPandas()
    assert len(out) == 300 and (out["rate"] >= 1).all() and (out["copies"] >= 1).all() and out["rate"].min() < 1.05
    mass = (out["n_tokens"] * out["rate"]).to_numpy() @ out[["p_law", "p_news", "p_code"]].to_numpy()
    assert mass / mass.sum() == pytest.approx(list(weights.values()), abs=0.01)
    ids = Encoder(default_tokenizer()).encode([r[1] for r in rows])
    assert sorted(out["n_tokens"]) == sorted(len(x) + 1 for x in ids)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(120):
        lanes, width = rng.integers(1, 6), rng.integers(2, 30)
        s, lengths = rng.integers(1, rng.integers(2, 5), (lanes, width)), rng.integers(1, width + 1, lanes)
        s[np.arange(lanes), lengths - 1] = 0
        sa = suffix_arrays(s.copy(), lengths.copy())
        for r in range(lanes):
            x = s[r, : lengths[r]].tolist()
            assert sa[r, : lengths[r]].tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_arrays_touch_what_is_at_hand(monkeypatch):
    """What the steps look through grows with the symbols, not with their square."""

    class Counting:
        seen = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def nonzero(self, a):
            Counting.seen += a.size
            return np.nonzero(a)

        def flatnonzero(self, a):
            Counting.seen += a.size
            return np.flatnonzero(a)

    monkeypatch.setattr(suffix_groups, "np", Counting())
    looked = []
    for width in (100, 400):
        s = np.random.default_rng(5).integers(1, 20, (30, width))
        s[:, -1], Counting.seen = 0, 0
        suffix_arrays(s, np.full(30, width))
        looked.append(Counting.seen)
    assert looked[1] < 6 * looked[0]


@pytest.mark.parametrize("length", [24, 50])
def test_runs_in_parts(monkeypatch, length):
    """The runs of a chunk are the same however it is parted; every whole string is in one, with its own smallest gram as anchor."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        texts = ["".join(rng.choice(list("abcd\u00e9")[: rng.integers(1, 6)], rng.choice([0, 1, length - 1, length, length + 1, 300]))) for _ in range(8)]
        chunk = next(bytescan.chunks(pa.array([*texts, None], pa.string())))
        found = []
        for part in (1 << 16, 64, 7, 1):
            monkeypatch.setattr(suffix_dedup, "PART", part)
            found.append(suffix_dedup.runs(chunk, length))
        assert all(np.array_equal(a, b) for other in found[1:] for a, b in zip(found[0], other, strict=True))
        gram = min(suffix_dedup.GRAM, length)
        at = np.arange(max(0, len(chunk.buf) - gram + 1))
        # The bit that marks frequent grams and those that hold the position do not count.
        order = (bytescan.span_hash(bytescan.prefix_hash(chunk.buf), at, at + gram) >> np.uint64(1)) >> np.uint64(suffix_dedup.INDEX_BITS)
        owned = [(int(r), p, int(o)) for r, a, b, o in zip(*found[0][:4], strict=True) for p in range(a, b + 1)]
        whole = [(r, p) for r in range(chunk.rows) for p in range(chunk.starts[r], chunk.ends[r] - length + 1)]
        assert owned == [(r, p, p + int(np.argmin(order[p : p + length - gram + 1]))) for r, p in whole]


def removed(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if i is not None and (s not in first or i < first[s]):
                first[s] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                m[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("joined", [1, 2, 8])
def test_segments_by_suffix_arrays(monkeypatch, joined):
    """Covered runs of segments as by brute force, with groups of all sizes cut deeper and deeper; periodic texts too."""
    monkeypatch.setattr(suffix_dedup, "JOINED", joined)
    rng = np.random.default_rng(3)
    source = [bytes(rng.integers(97, 99 + k, 300).astype(np.uint8)) for k in range(3)] + [b"abc" * 100, b"x" * 300]
    heads, body = [], b""
    for group in range(12):
        for _ in range(rng.integers(2, 30)):
            s = source[rng.integers(0, len(source))]
            a = rng.integers(0, 200)
            piece = s[a : a + int(rng.integers(50, 84))]
            heads.append((group, rng.integers(0, 9), rng.integers(0, 2), rng.integers(0, 3) * 1000, len(piece)))
            body += piece
    head = np.array(heads, suffix_dedup.HEAD)
    ends = np.cumsum(head["size"].astype(np.int64))
    found = suffix_dedup.compare_segments(head, np.frombuffer(body, np.uint8), ends - head["size"], 50)
    first, expected = {}, set()
    strings = [(int(h["group"]), int(h["doc"]), int(h["text"]), int(h["start"]) + k, body[e - h["size"] + k : e - h["size"] + k + 50]) for h, e in zip(head, ends, strict=True) for k in range(h["size"] - 49)]
    for g, d, _, _, x in strings:
        first[g, x] = min(d, first.get((g, x), d))
    for g, d, t, p, x in strings:
        if d > first[g, x]:
            expected |= {(d, t, p + k) for k in range(50)}
    assert {(int(c["doc"]), int(c["text"]), p) for c in found for p in range(c["start"], c["end"])} == expected


@pytest.mark.parametrize(("joined", "hot"), [(8, 256), (300, 300), (2, 3)])
def test_suffix_dedup(docs, none, spark, monkeypatch, joined, hot):
    monkeypatch.setattr(suffix_dedup, "JOINED", joined)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(1)
    base = "The quick brown fox jumps over the lazy dog and then some more text follows it here, always."
    rows = [(r[0], r[1]) for r in ROWS] + [(1000 + i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90))) + base + "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90)))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(suffix_dedup.remove_repeats(table), *columns) == want(removed(rows))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_texts_of_a_bucket_travel_and_are_read_together(spark):
    """However many buckets and however small the batches, a task's texts are a blob a bucket, and small blobs are opened together."""
    rows = [(i, None if i % 50 == 0 else f"text {i} " * (i % 7)) for i in range(3000)] + [(None, "x")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        dealt = suffix_dedup._dealt_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 40).collect()
    finally:
        spark.conf.set(name, before)
    assert len(dealt) == 40 and {r["bucket"] for r in dealt} == set(range(40))
    found = list(suffix_dedup._opened_texts(r["data"] for r in dealt))
    assert len(found) == 1 and sorted(map(str, zip(*(found[0].column(c).to_pylist() for c in ("doc_id", "text")), strict=True))) == sorted(map(str, rows))
    assert not list(suffix_dedup._opened_texts([]))
    limit = [b.num_rows for b in suffix_dedup._joined((pa.record_batch({"a": [1.0] * 10}) for _ in range(10)), 200)]
    assert limit == [30, 30, 30, 10]
