"""Language ID, near-dedup and quality rules."""

import math
import random
from collections import Counter

import brute
import numpy as np
from llm_rows import awkward, awkward_rows, byte_bpe, empty, make, word_bpe  # noqa: F401
from pyspark.sql import functions as F

from rankmix.llm import langid, near_dedup, quality

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ------------------------------------------------------------- language ID

def _greedy(sample: bytes, text: bytes) -> int:
    """Phrases by searching the sample itself."""
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) + 1 and text[at:at + n] in sample and at + n <= len(text):
            n += 1
        at += max(1, n - 1)
        phrases += 1
    return phrases


def test_cross_parsing_counts_phrases():
    rnd = random.Random(2)
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randint(1, 6)))
    samples = [(lang, " ".join(word(a) for _ in range(80)).encode()) for lang, a in (("x", "abc"), ("y", "bcd"))]
    texts = [" ".join(word("abcd") for _ in range(rnd.randint(0, 12))).encode() for _ in range(60)] + [b"", b"a"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.CrossParser(samples).phrases(np.frombuffer(b"".join(texts), np.uint8), off)
    for row, (_, sample) in zip(got, samples):
        assert row.tolist() == [_greedy(sample, t) for t in texts]


def test_language_accuracy_on_held_out_documents(spark):
    rows = langid.language_id(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(spark, awkward, awkward_rows, empty):
    got = langid.language_id(awkward).collect()
    assert len(got) == len(awkward_rows)
    for r in got:
        text = [t for i, t, *_ in awkward_rows if i == r.doc_id][0]
        if r.doc_id is not None and not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und" and r.score == 0
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert langid.language_id(empty).collect() == []
    kept = langid.with_language(documents(spark))
    assert kept.columns == documents(spark).columns
    unlabelled = langid.language_id(documents(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_prediction_reads_the_text_only(spark):
    docs = documents(spark)
    first = {r.doc_id: r.lang_pred for r in langid.language_id(docs).filter("held_out").collect()}
    other = docs.withColumns({"lang": F.when(langid.held_out("doc_id"), "zz").otherwise(F.col("lang")), "source": F.lit("q")})
    assert {r.doc_id: r.lang_pred for r in langid.language_id(other).filter("held_out").collect()} == first


def test_language_of_only_short_or_only_long_texts(spark):
    """50-byte texts and texts far above 20,000 bytes are learned from alike."""
    rnd = random.Random(5)
    words = {lang: ["".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))) for _ in range(60)]
             for lang, a in (("short", "abcdefgh"), ("long", "efghijkl"), ("usual", "ijklmnop"), ("few", "opqrstuv"))}
    size = {"short": 50, "long": 60_000, "usual": 2_000, "few": 50}

    def text(lang):
        out = "1234567890 " * 3_000 if lang == "long" else ""
        while len(out) < size[lang]:
            out += rnd.choice(words[lang]) + " "
        return out[:size[lang]]

    many = [lang for lang in ("short", "long", "usual") for _ in range(40)] + ["few"] * 4
    rows = [(i, text(lang), lang, "s", 0) for i, lang in enumerate(many)]
    frame = make(spark, rows, clashes=False)
    samples = dict(langid.language_samples(frame))
    assert sorted(samples) == sorted(words) and max(map(len, samples.values())) <= langid.SAMPLE_BYTES
    assert len(samples["long"]) > 0.9 * langid.SAMPLE_BYTES and len(samples["short"]) > 1000
    got = {r.doc_id: r.lang_pred for r in langid.language_id(frame).collect()}
    assert [got[i] for i, _, lang, *_ in rows if lang != "few"] == [lang for _, _, lang, *_ in rows if lang != "few"]
    assert langid.with_language(frame).filter("lang != 'few'").count() == 120


def test_short_texts_fill_the_sample(spark):
    rows = [(i, f"{'abcdefgh'[i % 8] * (i % 40 + 1)} text of a few words", "en", "s", 0) for i in range(3_000)]
    (_, sample), = langid.language_samples(make(spark, rows, clashes=False))
    assert 0.9 * langid.SAMPLE_BYTES < len(sample) <= langid.SAMPLE_BYTES


# ------------------------------------------------------------- near-dedup

def _check_components(frame, rows, percent):
    """Rows of one id are one node here: ids are distinct in ``rows``."""
    want, sizes = brute.components([r[0] for r in rows], [r[1] for r in rows], percent)
    got = near_dedup.near_duplicates(frame, percent).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)
    return got


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 150))]
        for _ in range(rnd.randint(1, 6)):
            text = [rnd.choice(words) if rnd.random() < rnd.choice([0, 0.005, 0.02, 0.04]) else w for w in base]
            rows.append((len(rows) * 3, " ".join(text).upper() if rnd.random() < 0.2 else "  ".join(text), "en", "s", 0))
    rows += [(9000, None, "", "", 0), (9001, "", "", "", 0), (9002, " \n", "", "", 0), (9003, "One two", "", "", 0),
             (9004, "one TWO", "", "", 0), (9005, "É é", "", "", 0), (9006, "é é", "", "", 0)]
    for percent in (85, 80):
        _check_components(make(spark, rows), rows, percent)


def test_near_duplicates_link_through_a_third(spark):
    """A bucket whose members are not all near its smallest one, or each other."""
    base = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = list(base)
        for j in range(i // 6):
            text[(37 * j) % 400] = f"changed{j}"
        text[i * 5] = f"own{i}"
        rows.append((i, " ".join(text), "en", "s", 0))
    _check_components(make(spark, rows), rows, 85)


def test_large_group_makes_few_pairs(spark, monkeypatch):
    """Pipeline's near_dedup: pairs of a group of near copies, not all near each
    other, grow with its members and not with their square."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rnd.randint(1, 3)):
            text[rnd.randrange(200)] = f"c{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(text), "en", "s", 0))
    pairs, links, confirmed, components = [], [], near_dedup.confirmed, near_dedup.components
    monkeypatch.setattr(near_dedup, "confirmed", lambda p, *a: pairs.append(p.count()) or confirmed(p, *a))
    monkeypatch.setattr(near_dedup, "components", lambda e: links.append(e.count()) or components(e))
    _check_components(make(spark, rows), rows, 80)
    assert sum(pairs) <= 8 * len(rows) and sum(links) <= 8 * len(rows)


def test_near_duplicates_awkward(awkward, awkward_rows, empty):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(awkward_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[4].component_id == by[5].component_id == 4
    assert by[1].n_shingles == 0 and by[1].component_id == 1
    assert {r.component_id for r in got if r.doc_id is None} == {4, None}
    assert near_dedup.near_duplicates(empty).collect() == []
    left = near_dedup.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns


def test_near_copies_without_ids(spark):
    """Rows without ids are linked and dropped like others; of a group without
    any id one row stays."""
    rnd = random.Random(8)
    base = [[f"w{rnd.randrange(10_000)}" for _ in range(120)] for _ in range(4)]
    copy = lambda b, k: " ".join(b + [f"x{k}"])
    texts = [(10, copy(base[0], 0)), (None, copy(base[0], 1)), (9, copy(base[0], 2)), (None, copy(base[0], 1))]
    texts += [(None, copy(base[1], k)) for k in (0, 1, 1, 2)]
    texts += [(None, " ".join(base[2])), (7, " ".join(base[3])), (None, ""), (None, ""), (None, None), (8, " ")]
    frame = make(spark, [(i, t, "en", "s", 0) for i, t in texts], clashes=False)
    rows = near_dedup.near_duplicates(frame).collect()
    assert Counter((r.component_id, r.kept) for r in rows if r.n_shingles) == Counter({
        (9, True): 1, (9, False): 3, (7, True): 1, (None, True): 2, (None, False): 3})
    assert all(r.kept and r.component_id == r.doc_id for r in rows if not r.n_shingles)
    left = near_dedup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len(got) == 8 and Counter(i for i, _ in got) == Counter({9: 1, 7: 1, 8: 1, None: 5})
    assert sum((t or "").startswith(" ".join(base[1])) for _, t in got) == 1


def test_signature_shapes_miss_few_pairs():
    for percent in (75, 80, 85, 90, 95):
        s, j = near_dedup.Shape.of(percent), percent / 100
        found = j ** s.chunk + s.chunk * j ** (s.chunk - 1) * (1 - j)
        assert (1 - found) ** s.chunks <= near_dedup.MISSED and s.far >= 2 * s.chunks - 1


# ------------------------------------------------------------- quality rules

def test_counts_against_brute_force(spark, awkward, awkward_rows):
    rnd = random.Random(5)
    bits = ["a", "b", " ", "\n", "é", "#", " a b c d e", "\x0b", "日"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))), "en", "s", 0) for i in range(800)]
    rows += [(1000, "\n", "", "", 0), (1001, "\n\n a\n\na\n a", "", "", 0)]
    for data, frame in ((rows, make(spark, rows)), (awkward_rows, awkward)):
        got = quality.document_counts(frame).collect()
        want = Counter((i, *brute.quality(t)) for i, t, *_ in data)
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                       for r in got) == want


def test_binomial_cdf_is_exact():
    for n, p in ((1, 0.5), (10, 0.01), (60, 0.3), (200, 0.05)):
        terms = [math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in range(n + 1):
            assert abs(quality.binomial_cdf(k, n, p) - sum(terms[:k + 1])) < 1e-9


def test_certified_cutoffs_hold_their_risk():
    """Over many samples a cutoff rejects more than alpha rarely."""
    rng, alpha, level, bad = np.random.default_rng(1), 0.05, 0.05, 0
    for _ in range(300):
        cells = np.minimum(rng.geometric(0.3, 400), quality.GRID)
        cut = quality.certified_cutoff(np.bincount(cells, minlength=quality.GRID + 1).tolist(), alpha, level)
        true_risk = 0.7 ** cut if cut is not None else 0
        bad += true_risk > alpha
    assert bad <= 300 * level * 1.6
    assert quality.certified_cutoff([5] + [0] * quality.GRID, alpha, level) is None


def test_quality_rules(spark, awkward, empty):
    good = "plain words make up this good line of text number {i} and go on for a while until it ends here"
    rows = [(i, good.format(i=i), "en", "s", 0) for i in range(3000)]
    junk = " ".join("%|$# &<>*" for _ in range(6)) + " a b"
    rows += [(5000 + i, junk + f" {i} x y z q r s t u v w", "en", "s", 0) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(None, 1, 0), (5000, None, 0), (2, 1, 0), (3, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(make(spark, rows), labels).collect()}
    assert sum(got[i].kept for i in range(3000)) >= 0.95 * 3000
    assert not any(got[5000 + i].kept for i in range(20))
    none = quality.quality_rules(awkward, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.quality_rules(empty, labels).collect() == []


def test_quality_verdicts_against_exact_sums(spark):
    """Cutoffs by exact fractions, cell by cell, and every document's verdict."""
    from fractions import Fraction
    rnd = random.Random(12)
    rows = []
    for i in range(2400):
        n = rnd.choice([12, 30, 90, 300])
        words = [rnd.choice(["a", "word", "longer", "#", "%x", "verylongwordindeed" * rnd.choice([1, 1, 3])]) + str(j) for j in range(n)]
        lines = [" ".join(words[j:j + 7]) for j in range(0, n, 7)]
        lines += lines[:rnd.choice([0, 0, 0, 1, 2])]
        rows.append((i, "\n".join(lines), "en", "s", 0))
    good = {i: rnd.random() < 0.7 for i in range(0, 2400, 2)}
    labels = spark.createDataFrame([(i, int(q), 0) for i, q in good.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(make(spark, rows), labels, alpha=0.25, delta=0.2).collect()}

    def cells(r):
        text = dict((x[0], x[1]) for x in rows[r.doc_id:r.doc_id + 1])[r.doc_id]
        lines, mean = len([x for x in text.split("\n") if x.strip()]), Fraction(r.word_chars, max(r.n_words, 1))
        ratios = (Fraction(r.n_symbols, max(r.word_chars, 1)), Fraction(r.n_dup_lines, max(lines, 1)),
                  Fraction(r.n_repeat_words, max(r.n_words, 1)), 1 - min(mean, Fraction(16)) / 16, min(mean, Fraction(64)) / 64)
        return [min(math.floor(x * quality.GRID), quality.GRID) for x in ratios]

    def stratum(r):
        return sum(r.n_words >= w for w in quality.STRATA)
    measures = len(quality.MEASURES)
    alpha, level = Fraction(1, 4) / measures, Fraction(1, 5) / ((len(quality.STRATA) + 1) * measures)

    def surely_less(k, n):
        """P(X <= k) <= level for X ~ Binomial(n, alpha), in whole numbers."""
        p, d = alpha.numerator, alpha.denominator
        below = sum(math.comb(n, i) * p ** i * (d - p) ** (n - i) for i in range(k + 1))
        return below * level.denominator <= level.numerator * d ** n
    cut = {}
    for s in range(len(quality.STRATA) + 1):
        for m in range(measures):
            held = [cells(r)[m] for i, r in got.items() if good.get(i) and not r.base_failed and stratum(r) == s]
            for c in range(quality.GRID - 1, -1, -1):
                if not held or not surely_less(sum(x > c for x in held), len(held)):
                    break
                cut[s, m] = c
    assert len(cut) > 5
    wrong = [i for i, r in got.items() if r.kept != (not r.base_failed and all(
        x <= cut.get((stratum(r), m), quality.GRID) for m, x in enumerate(cells(r))))]
    # a ratio on a cell's edge may fall to either side of it in floating point
    assert len(wrong) <= 5 and 0 < sum(not r.kept for r in got.values()) < 1200
