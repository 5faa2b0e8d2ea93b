"""Every operator on documents: awkward rows, empty tables, and brute force on a small corpus."""

import hashlib
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kelpstone.llm import components, digest, licences, linededup, mixing, neardup, packing, quality, shingles, tokencount, wordbpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, clean_text string, size int, line string, node string, labels string"
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def corpus() -> list[tuple]:
    rnd = random.Random(4)
    sentence = lambda n: " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 30)) for _ in range(n)) + "."
    texts = ["\n".join(sentence(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1].replace("alpha", "Alpha"), texts[2] + " more.", texts[3].replace(" ", "  ", 3)]
    texts += [t + "\nRead this first." for t in texts[10:20]]
    texts += [None, "", " \n\t", "word", "one two three four", "x" * 5000, "a b " * 3000, "é́ 日本語 ñ ß|", "All rights\nreserved. CC BY cc-by, general public license", "begin <|startoftext|> and <|endoftext|> end"]
    texts += ["Licensed under the Apache License, Version 2.0.", "Released under the  MIT License", "| a | b | c | d"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 7}", None if t is None else len(t), "k", "c", 1, "l", "n", "x") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[6], None, "s1", 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (7, "other text of the same id", "en", "s2", 25, *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts_are_those_of_brute_force(docs):
    seen = quality.assess(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(seen) == docs.count()
    for r in seen:
        w, t = words(r.text), r.text or ""
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_line_rules(spark):
    good = "This line is an ordinary sentence, and so it stays where it is in the text of the document."
    other = "Nothing else that anyone wrote on these pages before has had anything like such an ending!"
    rows = [(0, f"{good}\nHome | About | News | Contact\n{other}\nClick here to subscribe\n$$$ ### %%% x", "s", 1)]
    out = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).first()
    assert out["clean_text"] == f"{good}\n{other}" and out["kept"]


def test_lines_are_judged_without_the_blanks_around_them(spark):
    """Eleven words need no ending, twelve do, whatever tabs and carriage returns stand beside them."""
    eleven, twelve = "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven twelve"
    for before, after in (("", ""), ("\t", ""), ("", "\r"), (" \t", "\r"), ("", " " * 40)):
        rows = [(0, f"{before}{eleven}{after}"), (1, f"{before}{twelve}{after}"), (2, f"{before}{twelve}.”{after}")]
        out = {r.doc_id: r.kept_chars for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert (out[0], out[1], out[2]) == (len(eleven.replace(" ", "")), 0, len(twelve.replace(" ", "")) + 2)


def test_furniture_in_four_languages(spark):
    furniture = ["Alle Rechte vorbehalten.", "Hier klicken!", "Todos los derechos reservados.", "Leer más", "Haz clic aquí.", "Tous droits réservés.", "Abonnez-vous !", "All rights reserved.", "We use cookies."]
    prose = ["Er liest gern und klickt hier nicht.", "Le gusta leer mucho cada noche.", "Il a lu la suite du livre.", "He reserved all of his rights."]
    out = quality.assess(spark.createDataFrame([(i, x) for i, x in enumerate(furniture + prose)], "doc_id long, text string")).collect()
    assert all((r.kept_chars > 0) == (r.doc_id >= len(furniture)) for r in out)


def test_stages_keep_columns_and_clashing_names(docs):
    for clean in (quality.clean, linededup.clean, neardup.deduplicate, mixing.repeated):
        out = clean(docs)
        assert out.columns == docs.columns
        assert {r.kept for r in out.select("kept").distinct().collect()} <= {"k", None}
        assert {r.size for r in out.select("size").distinct().collect()} <= {1, None}


def test_empty_tables(none):
    for clean in (quality.clean, linededup.clean, neardup.deduplicate, mixing.repeated):
        assert clean(none).columns == none.columns and clean(none).isEmpty()
    for made in (quality.assess(none), linededup.remove(none), digest.compare_with_next(none), mixing.mix(none), packing.pack_documents(none, WORD), licences.scan(none), neardup.classes(none), tokencount.attribute(none, BYTES, public_tokenizers.PATTERN)):
        assert made.isEmpty()


def test_boilerplate_lines(spark):
    banner = "A line of prose that is far longer than page furniture is wont to be, on every page; " * 4
    blanks = ["", "\r", "\t", " \r"]
    rows = [(i, f"Own text number {i} of this very site, with enough words.\nAccept all cookies{blanks[i % 4]}\n{blanks[i % 4]}{banner}\nrare {i % 2}", f"site{i % 6}") for i in range(12)]
    rows += [(100 + i, "Quoted line one of a copied text.\nQuoted line two of a copied text.", f"site{i}") for i in range(6)]
    rows += [(200, None, "site0"), (201, "", None), (202, "Accept all cookies", "site9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in linededup.remove(docs).collect()}
    assert len(banner) > 300 and all(out[i].clean_text == f"Own text number {i} of this very site, with enough words.\nrare {i % 2}" and out[i].n_removed == 2 for i in range(12))
    assert all(out[100 + i].copied and out[100 + i].clean_text.count("Quoted") == 2 for i in range(6))  # copies are left alone
    assert out[200].clean_text is None and out[201].clean_text == "" and out[202].copied


def test_cross_site_lines_of_any_length_go(spark, tmp_path):
    import corpus_pipeline
    from kelpstone.llm import queries

    rnd = random.Random(8)
    sentence = lambda n: " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 99)) for _ in range(n)) + "."
    passage, local = sentence(60), sentence(60)
    rows = [(i, f"{sentence(80)}\n{passage}\n{sentence(80)}" + (f"\n{local}" if i < 4 else ""), f"site{i % 6}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = {i: t.replace(f"\n{passage}", "") for i, t, *_ in rows}  # the other passage is on four sites only
    out = queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.clean_sha256) for r in out} == {i: (1, hashlib.sha256(t.encode()).hexdigest()) for i, t in expected.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == expected


def test_short_pages_lose_cross_site_lines_that_are_most_of_them(spark):
    furniture = "Accept all of our cookies here\nSubscribe to our newsletter today"
    rows = [(i, f"{furniture}\nOwn {i}", f"site{i % 6}") for i in range(12)] + [(50 + i, f"{furniture}\n \nTwice", "site0") for i in range(2)] + [(90, f"{furniture}\n ", "site1")]
    out = {r.doc_id: r for r in linededup.remove(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((out[i].clean_text, out[i].n_removed, out[i].copied) == (f"Own {i}", 2, False) for i in range(12))
    assert all((out[i].clean_text, out[i].n_removed, out[i].copied) == (" \nTwice", 2, False) for i in (50, 51))
    assert (out[90].clean_text, out[90].n_removed, out[90].copied) == (rows[-1][1], 0, True)


def test_digest_of_next(docs):
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    expected = Counter()
    for i, (null, doc_id, _, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        own, other = digest.digest(text.encode()), digest.digest(edited.encode())
        expected[(None if null else doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest.to_text(*own), digest.to_text(*other), round(digest.likeness(own, other), 9), round(digest.likeness(own, digest.digest(after.encode())), 9))] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in digest.compare_with_next(docs).collect())
    assert got == expected


def test_each_range_of_ids_has_a_partition_of_its_own(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    made = spark.range(6000).select((7 * F.col("id") - 20_000).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        out = digest.compare_with_next(made)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("if (") < 10  # the plan doesn't grow with the ranges
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        bounds = list(range(3, 60, 4))
        numbered = spark.createDataFrame([(x,) for x in [*range(-2, 64), None]], "x long").withColumn("n", digest._range_number(bounds, "x")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert sum(sizes) == 6000 and len(sizes) == 60 and max(sizes) <= 120
    assert all(r.n == (len(bounds) if r.x is None else sum(b <= r.x for b in bounds)) for r in numbered)


@pytest.mark.parametrize("parts", [1, 40])
def test_ids_beyond_doubles_lose_no_row(spark, parts):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    ids = [2**62 + 3 * i for i in range(400)] + [-(2**62) - 5 * i for i in range(400)] + [2**63 - 1, -(2**63) + 1, None, None]
    made = spark.createDataFrame([(x, f"text {n}") for n, x in enumerate(ids)], "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = digest.compare_with_next(made).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert Counter(r.doc_id for r in got) == Counter(ids)
    texts = [t for _, _, t in sorted((x is None, x or 0, f"text {n}") for n, x in enumerate(ids))]
    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert Counter(r.edited_sha256 for r in got) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in edited)


def plain_digest(data):
    """The digest by its definition, one triplet at a time."""
    counts = [0] * 256
    for number, (_, j, k) in enumerate([(0, 4, 9), (0, 7, 15), (0, 11, 13), (0, 5, 17), (0, 13, 23), (0, 6, 19)]):
        for i in range(len(data)):
            a, b, c = (data[x] if x < len(data) else 0 for x in (i, i + j, i + k))
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D + number * 0x27D4EB2F) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            counts[h >> 24] += 1
    ordered = sorted(counts)
    codes = [(n > ordered[63]) + (n > ordered[127]) + (n > ordered[191]) for n in counts]
    length = 1 + round(np.log(len(data)) / np.log(1.1)) if data else 0
    packed = "".join(f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, 256, 4))
    return length, codes, f"{length:04x}{packed}"


def plain_likeness(a, b):
    most = sum(map(max, a[1], b[1]))
    apart = sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) / most if most else float(a[0] != b[0])
    return max(0.0, 1 - apart - 0.02 * max(0, abs(a[0] - b[0]) - 4))


def test_the_digest_is_that_of_its_definition():
    rnd = random.Random(11)
    texts = ["", "a", "é日", "some words of a text", *(" ".join(rnd.choice(VOCABULARY) for _ in range(n)) for n in (30, 200, 210))]
    made = [plain_digest(t.encode()) for t in texts]
    assert [digest.to_text(*digest.digest(t.encode())) for t in texts] == [m[2] for m in made]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert digest.likeness(digest.digest(a.encode()), digest.digest(b.encode())) == pytest.approx(plain_likeness(made[i], made[j]))


def test_digest_round_trip_and_bounds():
    rnd = random.Random(1)
    data = [bytes(rnd.randrange(97, 123) for _ in range(n)) for n in (0, 1, 2, 24, 500, 300_000)]
    for d in data:
        length, codes = digest.from_text(digest.to_text(*digest.digest(d)))
        assert (length, codes.tolist()) == (digest.digest(d)[0], digest.digest(d)[1].tolist())
        assert digest.likeness(digest.digest(d), digest.digest(d)) == 1.0
        assert all(0 <= digest.likeness(digest.digest(d), digest.digest(e)) <= 1 for e in data)
    assert np.array_equal(digest.bucket_counts(data[5], 1 << 10), digest.bucket_counts(data[5]))


def filled(sizes, weights, most=3):
    """Targets by the rule: by weight, what exceeds ``most`` times a size reshared among the others until none does."""
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = (sum(sizes) - sum(fixed.values())) / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if share * weights[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, share * weights[i]) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_mix_meets_targets(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in out)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    expected = filled([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])
    assert abs(sum(expected) - sum(sizes.values())) < 1e-6
    assert {(r.source_size, round(r.target, 6)) for r in out} <= {(sizes[s], round(t, 6)) for s, t in zip(order, expected, strict=True)}
    taken = defaultdict(int)
    for r in out:
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for (_, want), have in taken.items():
        assert abs(have - want) <= 2
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_the_mix_itself_is_what_the_plan_says(spark, docs):
    more = [(1, "a b c d", "s1"), (1, "a b c d e f g h i j", "s1"), (1, "one two three", "s2"), (None, "x y", "s1"), (None, "x y z", "s1"), (None, None, None), (2, "a b c d", "s1"), (2, "a b c d", "s1")]
    small = spark.createDataFrame(more, "doc_id long, text string, source string")
    for some in (docs, small):
        plan, rows = mixing.mix(some).collect(), mixing.repeated(some).collect()
        want = Counter()
        for r in plan:
            want[(r.doc_id, r["size"])] += r.times
        assert Counter((r.doc_id, len(words(r.text))) for r in rows) == +want


def test_many_sources(spark):
    rnd = random.Random(14)
    sizes = [rnd.choice([0, 1, 5, 40, 300]) for _ in range(400)]
    rows = [(i, " ".join("w" * n), None if i == 399 else f"host{i:03}") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = filled(sizes, [1 + i % 3 for i in range(400)])
    assert {r.doc_id: pytest.approx(r.target) for r in mixing.mix(docs).collect()} == dict(enumerate(expected))


def test_fit():
    # The long document doesn't fit, the short ones run out; the nearest is the long one alone.
    assert mixing.fit(np.array([3, 10_000_000]), np.array([5, 1]), 6_000_000).tolist() == [5, 1]
    assert mixing.fit(np.array([3, 10_000_000]), np.array([5, 1]), 4_000_000).tolist() == [5, 0]
    rnd = random.Random(3)
    for _ in range(40):
        lengths = np.array(sorted(rnd.sample(range(0, 200), 12)))
        counts = np.array([rnd.randint(1, 9) for _ in lengths])
        budget = rnd.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert ((0 <= take) & (take <= counts)).all()
        reachable = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            reachable = {s + k * n for s in reachable for k in range(c + 1)}
        assert abs(int((take * lengths).sum()) - budget) <= min(abs(s - budget) for s in reachable) + 2


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD)
    out = packing.pack_documents(docs, WORD, seq_len=256, with_ids=True).collect()
    expected = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 256):
            data = np.array(ids[at : at + 256], "<u4").tobytes()
            expected[(r.doc_id, at, len(data) // 4, zlib.crc32(data), len(ids), data)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in out) == expected
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256


def test_slots_pack_tightly():
    rnd = random.Random(5)
    histogram = Counter(min(2048, 1 + int(rnd.expovariate(1 / 500))) for _ in range(20_000))
    rows = packing.slots(dict(histogram))
    assert sum(r[2] - r[1] for r in rows) == sum(histogram.values())
    sequences = max(r[4] + (r[2] - r[1]) // r[3] for r in rows)
    assert sequences * 2048 <= 1.01 * sum(k * n for k, n in histogram.items())
    assert len(packing.slots({1: 10**12, 700: 10**9, 2048: 5})) < 2048


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    definition = open(WORD, encoding="utf-8").read()
    assert wordbpe.unreachable(definition) == []
    plain, own = Tokenizer.from_file(WORD), wordbpe.WordEncoder(definition, [])
    for text in ("hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>b<|startoftext|>\n<|endoftext|", "<|EndOfText|> é", "x" * 300 + "<|endoftext|>"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    rnd = random.Random(2)
    signs = [chr(c) for c in range(0x20, 0x180)] + list("abcdefghijklmnopqrstuvwxyz") * 20 + list("'`.,-\n\t\x1e\x1fΣİ́中<|>") + ["<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_token_counts(docs, spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    coder, back = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {v: k for k, v in ranks.items()}

    def spans(text):
        at = 0
        for i in coder.encode_ordinary(text):
            yield at, at + len(back[i])
            at += len(back[i])

    sections = [(r.doc_id, 1, 2, 40) for r in docs.collect() if r.doc_id not in (None, 5, 7)] + [(0, 2, 38, 90), (1, 2, -5, 10**6), (2, 3, 9, 9)]
    given = spark.createDataFrame(sections, "doc_id long, section long, start long, end long")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for rule in ("start", "end"):
        for r in tokencount.attribute(docs, BYTES, public_tokenizers.PATTERN, given, rule).collect():
            text = texts[r.doc_id]
            low, high = len(text[: r.start].encode()), len(text[: r.end].encode())
            all_spans = list(spans(text))
            assert r.tokens == sum(low <= (s if rule == "start" else e - 1) < high for s, e in all_spans)
            assert r.token_share == pytest.approx(sum(max(0, min(e, high) - max(s, low)) / (e - s) for s, e in all_spans))
            assert r.crossing == (sum(s < low < e or s < high < e for s, e in all_spans) if high > low else 0)
    nameless = spark.createDataFrame([(None, 1, 0, 5), (3, 1, 0, 5)], "doc_id long, section long, start long, end long")
    assert {r.doc_id for r in tokencount.attribute(docs, BYTES, public_tokenizers.PATTERN, nameless).collect()} == {3}  # a null id has no sections
    per_line = tokencount.attribute(docs, BYTES, public_tokenizers.PATTERN).where("doc_id is not null and doc_id not in (5, 7)")
    sums = per_line.groupBy("doc_id").sum("tokens", "token_share", "doc_tokens").join(per_line.groupBy("doc_id").max("doc_tokens"), "doc_id").collect()
    assert all(r[1] == r[4] and r[2] == pytest.approx(r[4]) for r in sums)


def licence_labels(text):
    """Brute force: every window and line against every template."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    find = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
    w, labels = find(low), set()
    for t in licences.TEMPLATES:
        template = find(t.text.lower())
        n, words_of = len(template), set(template)
        step = max(1, n // 4)
        blocks = [w[i : i + -(-5 * n // 4) + step - 1] for i in range(0, len(w), step)] + [x for x in map(find, low.split("\n")) if len(x) <= 2 * n]
        if any(5 * len(words_of & set(b)) >= 4 * len(words_of) and set(t.needs.split()) <= set(b) and not set(t.without.split()) & set(b) for b in blocks):
            labels.add(t.label)
    return labels


def test_licences(docs):
    out = licences.scan(docs).collect()
    assert len(out) == docs.count()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    base_phrases = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}
    for r in out:
        fits = []
        for text in texts[r.doc_id]:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            places = [(i, label) for label, p in base_phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
            base = {label for _, label in places}
            at = [i for i, _ in places]
            fits.append((len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | licence_labels(text)))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) in fits
        assert 0 <= r.score <= 1


#: Notices as they are met with, and all their labels, by hand.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "apache-2.0",
    "Licensed under the Apache License, Version 1.1.": "",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
    "General Public License, version 2": "gpl",  # too little of a notice
    "This work is licensed under the GNU Affero General Public License version 3.": "agpl-3.0,gpl",
    "This library is licensed under the GNU Lesser General Public License.": "gpl,lgpl",
    "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
    "Licensed under CC BY 3.0.": "cc-by,cc-by-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa",
    "Licensed under CC BY-ND 4.0.": "cc-by,cc-by-nd",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Released under the BSD License.": "bsd",
    "Released under the BSD 3-Clause License.": "bsd-3-clause",
    "Released under the MIT License.": "mit",
    "Licensed under the Artistic License 2.0.": "artistic-2.0",
    "Licensed under the Mozilla Public License Version 2.0": "mpl-2.0",
    "Licensed under the Mozilla Public License Version 1.1": "",
    "Released under the MIT License or, at your choice, licensed under the Apache License, Version 2.0.": "apache-2.0,mit",
    "All rights reserved.": "reserved",
    "Nobody under the sun has a license for that, version 2.0 or not.": "",
    "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction": "mit",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM OR DAMAGES": "",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation": "gpl",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "gpl,lgpl",
    "GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007": "gpl,gpl-3.0",
}


def test_licence_notices_get_just_their_own_labels(spark):
    rnd = random.Random(20)
    filler = lambda: " ".join(rnd.choice(VOCABULARY) for _ in range(40))
    rows, want = [], {}
    for notice, labels in NOTICES.items():
        for form in (notice, f"{filler()}\n{notice}\n{filler()}", f"{filler()} {notice} {filler()}", textwrap.fill(f"{filler()} {notice} {filler()}", 30)):
            want[len(rows)] = labels
            rows.append((len(rows), form))
    out = {r.doc_id: r.labels for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {rows[i][1]: x for i, x in out.items()} == {rows[i][1]: x for i, x in want.items()}


def test_licences_are_found_however_they_are_wrapped(spark):
    rnd = random.Random(12)
    rows, labels = [], {}
    for template in licences.TEMPLATES:
        for width in (24, 72):
            for at in range(0, 60, 7):  # words before, so that the notice begins anywhere in a line and in a window
                filler = lambda n: " ".join(rnd.choice(VOCABULARY) for _ in range(n))
                labels[len(rows)] = template.label
                rows.append((len(rows), textwrap.fill(f"{filler(at)} {template.text}. {filler(50)}", width)))
    out = licences.scan(spark.createDataFrame([*rows, (-1, None), (-2, "under\nthe"), (-3, "MIT\nLicense")], "doc_id long, text string")).collect()
    assert all(labels[r.doc_id] in r.labels.split(",") for r in out if r.doc_id >= 0)
    assert all((r.labels, r.score) == ("", 0.0) for r in out if r.doc_id < 0)


def weighted(texts):
    """Brute-force weighted sets, with exact document frequencies."""
    found = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        found.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)]) if w else Counter())
    df = Counter(x for f in found for x in f)
    n = sum(bool(f) for f in found)
    idf = {x: 1 + shingles.IDF_GAIN * min(1, max(0, np.log(c / n) / np.log(shingles.RARE))) for x, c in df.items()}
    return [{x: (1 + np.log(c)) * idf[x] for x, c in f.items()} for f in found]


def test_near_duplicates_are_those_of_brute_force(spark):
    rnd = random.Random(6)
    base = [[rnd.choice(VOCABULARY) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(60, 200))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(rnd.randint(1, 6)):
            c = list(b)
            for _ in range(rnd.randint(1, 6)):
                c[rnd.randrange(len(c))] = "changed" + str(rnd.randint(0, 999))
            texts.append(" ".join(c))
    texts += [texts[0], texts[40].upper(), "", None, "two words", "Two  words", " "]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = weighted(texts)
    up = list(range(len(texts)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in range(len(texts)):
        for j in range(i):
            common = sum(min(w, sets[j][x]) for x, w in sets[i].items() if x in sets[j])
            total = sum(sets[i].values()) + sum(sets[j].values()) - common
            if total and common / total >= neardup.THRESHOLD:
                up[max(top(i), top(j))] = min(top(i), top(j))
    assert {i: out[i].class_id for i in out} == {i: top(i) for i in range(len(texts))}
    assert sorted(i for i in out if out[i].keep) == sorted({top(i) for i in range(len(texts))})


def test_buckets_larger_than_a_block(spark, monkeypatch):
    """A bucket whose texts meet over several blocks loses no link."""
    monkeypatch.setattr(neardup, "STAR", 3)
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "MANY", 3)
    monkeypatch.setattr(neardup, "BROADCAST_NODES", -1)
    test_near_duplicates_are_those_of_brute_force(spark)


def test_long_texts_in_little_memory(spark, monkeypatch):
    """Long texts are drawn from and compared in parts, with the same results, and dealt by their bytes."""
    monkeypatch.setattr(neardup, "HELD", 50)
    monkeypatch.setattr(neardup, "LOT_BYTES", 2000)
    monkeypatch.setattr(neardup, "SLICE_BYTES", 1500)
    test_near_duplicates_are_those_of_brute_force(spark)


def test_a_long_text_takes_memory_in_proportion(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 1 << 20, 3_000_000)))  # 22 MB, 3 million words
    tracemalloc.start()
    ((_, of, hashes),) = shingles.blocks([text])
    owner, shingle, times = shingles.elements(of, hashes)
    log_weight = np.log(shingles.weights(shingle, times, np.ones(1 << shingles.DF_BITS, np.float32)))
    texts, bands = neardup.signatures(owner, shingle, log_weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.tolist() == [0] and bands.shape == (1, neardup.BANDS) and peak < 12 * len(text)
    monkeypatch.setattr(neardup, "HELD", 1 << 40)
    assert (neardup.signatures(owner, shingle, log_weight)[1] == bands).all()
    half = slice(0, len(shingle), 2)
    weight = np.ones(len(shingle), np.float32)
    assert neardup._shared((0, b"", shingle, weight, 0), (0, b"", shingle[half], weight[half], 0)) == len(shingle[half])


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({out[i] for i in range(41)}) == 1 and len({out[i] for i in range(100, 160)}) == 1 and out[200] == out[201]
    assert len(set(out.values())) == 3


def test_signatures_agree_as_sets_do():
    """The share of equal places is the weighted Jaccard similarity."""
    rng = np.random.default_rng(1)
    shared, mine, other = (rng.integers(0, 1 << 52, n).astype(np.uint64) for n in (800, 100, 100))
    equal = []
    for odd in range(12):
        with_salt = lambda x: np.sort(x ^ np.uint64(odd * 0x123456789 & (1 << 52) - 1))  # noqa: B023, E731
        a, b = with_salt(np.concatenate((shared, mine))), with_salt(np.concatenate((shared, other)))
        of = np.repeat([0, 1], 900)
        _, bands = neardup.signatures(of, np.concatenate((a, b)), np.full(1800, np.log(1.2), np.float32))
        equal.append((bands[0] == bands[1]).mean())
    assert abs(np.mean(equal) - 0.8**neardup.ROWS) < 0.12


def made_corpus(rnd):
    """Documents of which the quality rules keep most: prose, furniture that many sites share, near copies, junk, long and short ones."""
    sentence = lambda n: " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 400)) for _ in range(n)) + "."
    furniture = [f"Here is line {k} that each of the sites shows on its pages." for k in range(3)]
    rows = []
    for i in range(70):
        lines = [sentence(rnd.randint(14, 40)) for _ in range(rnd.randint(2, 9))]
        if i % 3 == 0:
            lines.insert(1, furniture[i % 9 // 3])
        rows.append((i, "\n".join(lines), "en", f"site{i % 8}", 0))
    for k in range(12):
        words_of = rows[k][1].split(" ")
        words_of[len(words_of) // 2] = "altered7"
        rows.append((100 + k, " ".join(words_of), "en", f"site{k % 8}", 0))
    rows += [(200, "too short", "en", "site1", 0), (201, None, "en", "site1", 0), (202, rows[5][1], "en", None, 0), (203, "$$$ ### " * 40, "en", "site2", 0), (204, " ".join(["same words again and again and again now"] * 9), "en", "site3", 0)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]


def test_pipeline_stages_are_those_of_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = made_corpus(random.Random(77))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    tables, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        tables[name] = now.collect()
    assert list(tables) == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "packing"]

    kept = {r.doc_id: r for r in tables["quality_rules"]}
    assert set(kept) == {r[0] for r in rows} - {200, 201, 203, 204} and all(kept[i].text == dict((r[0], r[1]) for r in rows)[i] for i in kept)

    sites = defaultdict(set)
    for r in kept.values():
        for line in r.text.split("\n"):
            sites[line].add(r.source)
    cut = {i: "\n".join(x for x in r.text.split("\n") if len(sites[x]) < 5) for i, r in kept.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in tables["line_dedup"]} == {i: (t, len(t)) for i, t in cut.items()} and cut != {i: r.text for i, r in kept.items()}

    ids = sorted(cut)
    sets, up = weighted([cut[i] for i in ids]), list(range(len(ids)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in range(len(ids)):
        for j in range(i):
            common = sum(min(w, sets[j][x]) for x, w in sets[i].items() if x in sets[j])
            if common >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - common):
                up[max(top(i), top(j))] = min(top(i), top(j))
    assert Counter(r.doc_id for r in tables["near_dedup"]) == Counter({ids[top(i)] for i in range(len(ids))}) and len(tables["near_dedup"]) < len(ids) - 5

    size = Counter()
    for r in tables["near_dedup"]:
        size[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s))
    wanted = dict(zip(order, filled([size[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken, times = Counter(), Counter(r.doc_id for r in tables["source_mixing"])
    for r in tables["source_mixing"]:
        taken[r.source] += len(words(r.text))
    assert max(times.values()) <= 3 and all(abs(taken[s] - wanted[s]) <= 5 for s in order)

    plain, pieces, sequences = Tokenizer.from_file(WORD), Counter(), defaultdict(list)
    for r in tables["source_mixing"]:
        data = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(data), 2048):
            pieces[(r.doc_id, at, min(2048, len(data) - at), zlib.crc32(data[at : at + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in tables["packing"]) == pieces
    for r in tables["packing"]:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert sum(n for *_, n in [(0, k[2] * v) for k, v in pieces.items()]) >= 0.9 * 2048 * (len(sequences) - 1)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in tables["packing"])


def test_pipeline_takes_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.clean(docs).select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= kept
