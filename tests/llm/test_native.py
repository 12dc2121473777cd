"""Exact dedup, line dedup, personal data, mixing: awkward rows and brute force."""

import hashlib
import random
from collections import Counter

import brute
from llm_rows import awkward, awkward_rows, byte_bpe, empty, make, word_bpe  # noqa: F401

from rankmix.llm import exact_dedup, line_dedup, mixing, pii

SF = "/root/testdata/sf0.001"


def test_exact_groups_awkward(awkward, awkward_rows):
    rows = exact_dedup.exact_groups(awkward, keep="largest").collect()
    assert len(rows) == len(awkward_rows)
    size = Counter(brute.lower(t) for _, t, *_ in awkward_rows)
    stay = {}
    for i, t, *_ in awkward_rows:
        if i is not None:
            stay[brute.lower(t)] = max(i, stay.get(brute.lower(t), i))
    want = Counter((i, stay.get(brute.lower(t)), size[brute.lower(t)], i == stay.get(brute.lower(t)),
                    hashlib.sha256(brute.lower(t).encode()).hexdigest()) for i, t, *_ in awkward_rows)
    assert Counter(tuple(r) for r in rows) == want


def test_drop_copies_leaves_one_row(awkward):
    left = exact_dedup.drop_copies(awkward, keep="largest")
    assert left.columns == awkward.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6, 7, 8, 9]
    small = exact_dedup.drop_copies(awkward, keep="smallest")
    assert sorted(r.doc_id for r in small.collect()) == [1, 3, 4, 6, 7, 8, 9]


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.drop_copies(empty).collect() == []
    assert line_dedup.line_dedup(empty).collect() == []
    assert pii.pii_digest(empty).collect() == []
    assert mixing.mix(empty, 80, {}).collect() == []
    assert mixing.mixed_documents(empty, 80, {}).collect() == []


def _lines_brute(rows, min_docs):
    white = " \t\n\x0b\f\r"
    docs = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(brute.lower(line.strip(white)), set()).add(i)
    hot = {k for k, d in docs.items() if k and len(d) >= min_docs}
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if brute.lower(x.strip(white)) not in hot]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(spark, awkward, awkward_rows):
    rnd = random.Random(1)
    rows = [(i, "\n".join(rnd.choice(["a", " A\t", "b", "", "c c", "é", "x" + str(rnd.randint(0, 40))])
                          for _ in range(rnd.randint(0, 9))), "en", "s", 0) for i in range(60)]
    for data, frame, n in ((awkward_rows, awkward, 2), (rows, make(spark, rows), 10)):
        got = line_dedup.line_dedup(frame, min_docs=n).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == _lines_brute(data, n)
        for r in got:
            assert sum(x["length"] for x in r.keep_runs) == r.n_lines - r.n_dropped


def test_line_dedup_keeps_first(spark):
    rows = [(i, "same\nown " + str(i) + "\nsame", "en", "s", 0) for i in range(5)]
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(make(spark, rows), 2, keep_first=True).collect()}
    assert got == {0: "same\nown 0"} | {i: f"own {i}" for i in range(1, 5)}


def test_line_salts_do_not_matter(spark, awkward):
    a, b = (sorted(map(str, line_dedup.line_dedup(awkward, min_docs=2, salts=s).collect())) for s in (1, 64))
    assert a == b


def test_pii_against_brute_force(spark, awkward, awkward_rows):
    rnd = random.Random(3)
    bits = list("ab.@+-_ 0123456789()%é\n") + ["@a.b", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111",
                                               "DE89 3704 0044 0532 0130 00", "256.1.1.1", "000255.0.0.1"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))), "en", "s", 0) for i in range(1500)]
    rows += [(5000, "1" * 3000, "", "", 0), (5001, "a.b@" * 2000, "", "", 0), (5002, "x@y.z_foo@bar.com", "", "", 0)]
    for data, frame in ((awkward_rows, awkward), (rows, make(spark, rows))):
        want = Counter()
        for i, t, *_ in data:
            n, sha, _ = brute.pii(t)
            want[(i, *n.values(), sha)] += 1
        got = pii.pii_digest(frame).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_pii_long_texts_do_not_overflow(spark):
    rows = [(0, "1" * 200_000, "", "", 0), (1, "1 " * 60_000, "", "", 0), (2, "a" * 200_000, "", "", 0),
            (3, "+1" + "(" * 100_000, "", "", 0), (4, "1." * 60_000, "", "", 0)]
    assert len(pii.pii_digest(make(spark, rows)).collect()) == 5


def test_pii_iban_and_context(spark):
    text = "Please pay to IBAN DE89 3704 0044 0532 0130 00 or call +49 30 1234567, not DE89370400440532013001."
    row = pii.pii_spans(make(spark, [(1, text, "de", "s", 0)])).first()
    assert row.n_iban == 1 and row.n_phone == 1
    by_kind = {pii.KINDS[s.kind_no]: s for s in row.found}
    assert text[by_kind["iban"].start:by_kind["iban"].end] == "DE89 3704 0044 0532 0130 00"
    assert by_kind["iban"].score == 1.0 and by_kind["phone"].score == 0.7
    assert [s.kind_no for s in row.base] == [3]


def test_pii_iban_beside_words_and_numbers(spark):
    """IBANs of 15 to 28 characters, with blanks and without, followed or
    preceded by capital words, numbers and each other."""
    ibans = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332",
             "CZ65 0800 0000 1920 0014 5399", "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947",
             "DE89 3704 0044 0532 0130 00"]
    ibans += [i.replace(" ", "") for i in ibans]
    texts, want = [], []
    for i in ibans:
        for before in ("", "to ", "REF AB12 ", "to XY99 1234 "):
            for after in ("", " BIC", " EUR", " IN", " 500", " 2024", " BANK", " 1234 5678", " INVOICE", ", ok"):
                texts.append(f"{before}{i}{after}")
                want.append([i])
    texts += [f"{i} {k}" for i, k in zip(ibans, ibans[1:])]
    want += [[i, k] for i, k in zip(ibans, ibans[1:])]
    texts += ["ES92 2100 0418 4502 0005 1332 BIC", "ES9121000418450200051332EUR"]    # wrong check digits; one word
    want += [[], []]
    rows = pii.pii_spans(make(spark, [(k, t, "de", "s", 0) for k, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        got = [text[x.start:x.end] for x in r.found if x.kind_no == pii.KINDS.index(pii.IBAN)]
        assert got == want[r.doc_id], text
        assert r.n_iban == len(got)


def _supply(rows):
    return sum((len((t or "").encode()) + 3) // 4 for _, t, *_ in rows)


def test_mixing_budgets(spark):
    rows = [(i, "x" * 40, "en", "src0", 0) for i in range(100)] + [(200 + i, "x" * 40, "en", "src4", 0) for i in range(10)] \
        + [(300 + i, "x" * 40, "de", "src1", 0) for i in range(100)]
    got = mixing.mix(make(spark, rows), 50, {"domain": {"domain0": 1, "domain1": 1}}, max_epochs=2).collect()
    spent = Counter()
    for r in got:
        spent[r.source] += r.copies * r.n_tokens
    # 2100 tokens, budget 1050, 525 a domain; src4 has 100 x 2 epochs at most, its sibling takes the rest
    assert dict(spent) == {"src0": 320, "src4": 200, "src1": 520}
    assert {r.copies for r in got if r.source == "src4"} == {2}


def test_mixing_shortage_reaches_ancestors(spark):
    rows = [(i, "x" * 4, "en", "src0", 0) for i in range(10)] + [(100 + i, "x" * 4, "de", "src1", 0) for i in range(200)]
    spent = Counter()
    for r in mixing.mix(make(spark, rows), 60, {"domain": {"domain0": 9}}, max_epochs=1).collect():
        spent[r.source] += r.copies
    assert dict(spent) == {"src0": 10, "src1": 116}


def test_mixing_awkward(awkward, awkward_rows):
    got = mixing.mix(awkward, 100, {}, max_epochs=1).collect()
    assert sum(r.n_tokens * r.copies for r in got) <= _supply(awkward_rows)
    assert {(r.lang, r.source) for r in got} >= {("none", "none"), ("en", "none")}
    rows = mixing.mixed_documents(awkward, 100, {}, max_epochs=1)
    assert rows.columns == awkward.columns


def test_mixing_zero_weight_and_seed(spark):
    rows = [(i, "x" * 40, "en", f"src{i % 2}", 0) for i in range(80)]
    frame = make(spark, rows)
    only = mixing.mix(frame, 50, {"source": {"src1": 0}}, max_epochs=1).collect()
    assert {r.source for r in only} == {"src0"}
    a, b = ({r.doc_id for r in mixing.mix(frame, 30, {}, seed=s).collect()} for s in (1, 2))
    assert a != b and len(a) == len(b)


def test_mixing_holds_budgets_without_ids_and_with_repeated_ones(spark):
    """A hundred rows without an id, equal texts or not; ten ids ten times each."""
    text = lambda i: f"{i:04d}" + "x" * 36
    for rows in ([(None, text(0), "en", "src0", 0)] * 100, [(None, text(i), "en", "src0", 0) for i in range(100)],
                 [(i % 10, text(i), "en", "src0", 0) for i in range(100)], [(i % 10, text(0), "en", "src0", 0) for i in range(100)],
                 [(1, text(0), "en", "src0", 0), (1, text(1), "en", "src0", 0), (1, text(0), "de", "src0", 0)] * 20):
        frame = make(spark, rows)
        chosen = mixing.mix(frame, 50, {}, max_epochs=2)
        n = sum(r.copies for r in chosen.collect())
        got = mixing.mixed_documents(frame, 50, {}, max_epochs=2).collect()
        assert 0 < len(got) == n and 10 * n <= _supply(rows) / 2
        assert {(r.doc_id, r.text, r.lang) for r in got} <= {x[:3] for x in rows}


def test_pii_scores_read_both_sides(spark):
    texts = ["call 555 +49 30 1234567 or +49 30 7654321", "+49 30 1234567 is my phone", "+49 30 1234567, " + "x" * 40 + " phone",
             "see version 10.0.0.1 and 10.0.0.2", "10.0.0.1 10.0.0.2 10.0.0.3 10.0.0.4 10.0.0.5 10.0.0.6 server"]
    rows = pii.pii_digest(make(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()
    got = {r.doc_id: r.scores for r in rows}
    assert got == {0: "70,70", 1: "70", 2: "60", 3: "40,40", 4: "60,60,70,70,70,70"}


def test_pii_reference_sql_agrees(spark, awkward_rows):
    """The query's SQL on the texts of the tests above: IBANs beside words,
    context on both sides, awkward rows."""
    import duckdb

    from rankmix.llm import oracle
    ibans = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947",
             "DE89370400440532013000"]
    texts = [f"{b}{i}{a}" for i in ibans for b in ("", "IBAN ", "to XY99 1234 ", "REF AB12 ") for a in (" BIC", " 500", ", bank", " XK12 1234")]
    texts += ["call 555 +49 30 1234567 or +49 30 7654321", "10.0.0.1 10.0.0.2 10.0.0.3 10.0.0.4 server", "a@b.de 4111 1111 1111 1111 visa"]
    texts += [t for _, t, *_ in awkward_rows if t and len(t) < 1000]
    rows = [(k, t, "de", "s", 0) for k, t in enumerate(texts)]
    got = pii.pii_digest(make(spark, rows)).toPandas()
    con = duckdb.connect()
    con.execute("create table x (doc_id bigint, text varchar)")
    con.executemany("insert into x values (?, ?)", [r[:2] for r in rows])
    want = con.execute(oracle.op10("x")).df()[list(got.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
    assert (want.spans != "").sum() > 60
