import random
import re
from collections import Counter, defaultdict

import pytest

from tideline.llm import mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return re.sub(r"[0-9\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def verdicts(rows):
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, _, s in rows:
        hosts[s or ""].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                held[s or "", normal(x)].add(t)
    frequent = {k for k, v in held.items() if len(v) > quality.MIN_DOCS and len(v) > quality.MAX_SHARE * len(hosts[k[0]])}
    out = []
    for i, t, _, s in rows:
        m = measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        removed = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and (s or "", normal(x)) in frequent)
        out.append((i, *m, failed, removed, not failed and m[0] - removed >= quality.MIN_LEFT * m[0]))
    return sorted(out), frequent


def quality_rows():
    r = random.Random(6)
    line = lambda n: " ".join(r.choice(["a", "the", "x|y", "<b>", "$5", "12", "Word", "é"]) + str(r.randrange(900)) for _ in range(n))
    hot, rows = "Subscribe to our NEWS letter number 7 now", []
    for i in range(160):
        lines = [line(r.randrange(1, 30)) for _ in range(r.randrange(1, 6))]
        if i % 2:
            lines.insert(r.randrange(len(lines) + 1), hot.replace("7", str(i)) if i % 4 else hot + "\t" * (i % 5))
        if i % 10 == 0:
            lines += lines[:1] * 3
        if i % 17 == 0:
            lines = [" ".join(hot.split() * 2)] * 9 + ["Terms of use apply"]
        rows.append((i, "\n".join(lines), "en", f"host{i % 2 * (i % 3)}" if i % 29 else None))
    rows += [(1000 + k, rows[1][1], "en", "host1") for k in range(40)]
    rows += [(2000 + k, f"{hot}\n" * 12 + f"own{k}", "en", "host1") for k in range(30)]
    return rows


def test_quality_matches_brute_force(docs):
    rows = quality_rows()
    want, frequent = verdicts(rows)
    got = quality.quality(docs(rows))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
    assert frequent and any(x[-2] for x in want)
    kept = {x[0] for x in want if x[-1]}
    texts = {r["doc_id"]: r["text"] for r in quality.clean(docs(rows)).collect()}
    assert set(texts) == kept
    by = {r[0]: r for r in rows}
    for i, t in texts.items():
        host = by[i][3] or ""
        assert t == "\n".join(x for x in by[i][1].split("\n") if not (WORD.search(x) and (host, normal(x)) in frequent))


def test_quality_of_a_long_repetitive_text(docs):
    text = " ".join(f"w{k % 700}" for k in range(3000)) + " " + " ".join(f"u{k}" for k in range(5000))
    got = quality.quality(docs([(1, text)])).first()
    assert (got["n_words"], got["n_repeat_words"]) == (8000, measures(text)[4])


def test_repeated_words_are_exact_under_colliding_hashes(docs, monkeypatch):
    """With three bits of hash all windows meet; words decide."""
    from pyspark.sql import functions as F

    from tideline.llm import exprs

    r = random.Random(11)
    rows = [(k, " ".join(r.choice("abcdefg") for _ in range(r.randrange(60)))) for k in range(60)] + [(99, " ".join(f"u{k}" for k in range(400)))]
    narrow = type("F", (), {**{n: staticmethod(getattr(F, n)) for n in dir(F) if callable(getattr(F, n))}, "xxhash64": staticmethod(lambda *c: F.shiftleft(F.pmod(F.xxhash64(*c), F.lit(8)), 60))})
    monkeypatch.setattr(exprs, "F", narrow)
    got = {x["doc_id"]: x["n"] for x in docs(rows).select("doc_id", exprs.repeated_words(exprs.words(F.col("text"))).alias("n")).collect()}
    assert got == {i: measures(t)[4] for i, t in rows}


def test_quality_edges(edges, empty):
    got = quality.quality(edges)
    assert got.count() == edges.count() and got.where("doc_id < 5 AND NOT base_failed").count() == 0
    assert quality.quality(empty).count() == 0 and quality.clean(empty).count() == 0
    assert quality.clean(edges).columns == edges.columns


PEOPLE = [
    (1, "Write to Jane.Doe+x@mail7.example.com or +1 (017) 555-7713, from 10.20.30.40."),
    (2, "jane.doe+x@mail7.example.com; phone +1 (017) 555-7713 and 017-555-7713; card 4845168114407329, not 4845168114407320"),
    (3, "Mrs. Anna Schmidt met Herr Schmidt; г-н Иванов came. IBAN DE89370400440532013000, id 123-45-6789."),
    (4, "version 1.2.3.4.5, 999.1.1.1, room 12-34, @handle, a@b, 12345678901234567890123"),
    (5, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111 and 4111111111111111."),
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_surrogates(docs):
    got = {r["doc_id"]: r for r in pii.pseudonymize(docs(PEOPLE)).collect()}
    out = {i: r["text"] for i, r in got.items()}
    for old in ("Jane", "jane", "Doe", "mail7", "555-7713", "10.20.30.40", "4845168114407329", "Schmidt", "Иванов", "370400", "123-45-6789", "1111 1111"):
        assert all(old not in t for t in out.values())
    m1 = re.fullmatch(r"Write to ([A-Z][a-z]{3}\.[A-Z][a-z]{2}\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com) or (\+\d \(\d{3}\) \d{3}-\d{4}), from ((?:\d{1,3}\.){3}\d{1,3})\.", out[1])
    m2 = re.fullmatch(r"(\S+); phone (\+1 \(\d{3}\) \d{3}-\d{4}) and (\d{3}-\d{3}-\d{4}); card (\d{16}), not 4845168114407320", out[2])
    assert m1 and m2 and m1[1].lower() == m2[1] and m1[2] == m2[2]
    assert luhn(m2[4]) and m2[4][0] == "4"
    m3 = re.fullmatch(r"Mrs\. (\w+) (\w+) met Herr (\w+); г-н ([а-яА-Я]+) came\. IBAN DE[0-9]{20}, id \d{3}-\d{2}-\d{4}\.", out[3])
    assert m3 and m3[1].endswith("a") and m3[3].endswith("n")
    assert out[4] == PEOPLE[3][1] and got[4]["n_entities"] == 0
    cards = re.findall(r"\d[\d -]+\d", out[5])
    assert [re.sub(r"\d", "9", c) for c in cards] == ["9999 9999 9999 9999", "9999-9999-9999-9999", "9" * 16]
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0]))
    assert (got[2]["n_email"], got[2]["n_phone"], got[2]["n_card"]) == (1, 2, 1)
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs(PEOPLE)).collect()}
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs(PEOPLE), key="another").collect()}
    assert again == out and other[1] != out[1]


def test_surrogates_stay_distinct(spark, docs):
    """Short forms collide by chance; the check draws again until all differ and none is real."""
    from pyspark.sql import functions as F

    emails = [f"{a}@{b}.io" for a in "abcdefghij" for b in "klmn"]
    phones = [f"017-555-{k:04}" for k in range(300)]
    rows = [(k, f"see {e} or {phones[k % 300]}") for k, e in enumerate(emails * 8)]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs(rows)).collect()}
    mapped = defaultdict(set)
    for i, text in rows:
        for a, b in zip(text.split()[1::2], out[i].split()[1::2], strict=True):
            mapped[a].add(b)
    assert all(len(v) == 1 for v in mapped.values())
    values = [next(iter(v)) for v in mapped.values()]
    assert len(set(values)) == len(mapped) and not set(values) & set(mapped)
    pairs = spark.range(3000).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 10, "0").alias("canon"))
    assert pairs.select(pii.surrogate(F.col("kind"), F.col("canon"), F.lit(0), "k")).distinct().count() == 3000


def test_domains_stay_distinct_and_coreferent(docs):
    domains = [f"{a}{b}.io" for a in "abcd" for b in "wxyz"] + [f"{a}.io" for a in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(k, f"ann@{d} and bob@{d}") for k, d in enumerate(domains)]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs(rows)).collect()}
    new = {}
    for k, d in enumerate(domains):
        one, two = re.fullmatch(r"\S+@(\S+) and \S+@(\S+)", out[k]).groups()
        assert one == two and one.endswith(".io")
        new[d] = one
    assert len(set(new.values())) == len(domains) and not set(new.values()) & set(domains)


def test_a_domain_of_many_labels_needs_a_bounded_stack(docs):
    rows = [(1, "x@" + "a." * 100_000), (2, "x@" + "a." * 100_000 + "com y@b.com"), (3, "a" * 300_000 + "@"), (4, "x@" + "a" * 300_000), (5, "1:" * 100_000), (6, "12 " + "Aa " * 100_000), (7, "Calle " + "Aa " * 50_000), (8, "A" + "a" * 300_000 + "weg"), (9, "+" + "1 " * 100_000)]
    got = {r["doc_id"]: r for r in pii.pseudonymize(docs(rows)).collect()}
    assert got[1]["n_email"] == 0 and got[2]["n_email"] == 1 and got[2]["text"][:200_005] == rows[1][1][:200_005] and "y@b.com" not in got[2]["text"]
    assert all(len(got[i]["text"]) == len(t) for i, t in rows if i not in (2, 9))


def iban_rest(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_ibans_get_valid_check_digits(docs):
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO93 8601 1117 947", "BE68 5390 0754 7034"]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs([(k, f"to {x}.") for k, x in enumerate(ibans)])).collect()}
    for k, x in enumerate(ibans):
        new = got[k][3:-1]
        assert iban_rest(x) == 1 == iban_rest(new) and new != x and new[:2] == x[:2] and len(new) == len(x)


def test_mapping_of_very_many_short_names(spark):
    from pyspark.sql import functions as F

    names = spark.range(300_000).select(F.lit("name").alias("kind"), F.concat(F.lit("m:"), F.initcap(F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"))).alias("canon"))
    got = pii.mapping(names, "k")
    assert got.agg(F.count("*"), F.count_distinct("canon"), F.count_distinct("s")).first() == (300_000,) * 3


def test_key_of_the_session(spark, docs):
    rows = docs([(1, "a.person@mail.org")])
    texts = [pii.clean(rows, "k1").first()["text"]]
    spark.conf.set(pii.KEY_SETTING, "k1")
    try:
        texts.append(pii.clean(rows).first()["text"])
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert texts[0] == texts[1] != pii.clean(rows).first()["text"]


def test_surrogate_edges(edges, empty):
    assert sorted(map(str, pii.clean(edges).collect())) == sorted(map(str, edges.collect()))
    assert pii.clean(empty).count() == 0 and pii.pseudonymize(empty).count() == 0


def test_raked_marginals(docs, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-7)
    r = random.Random(8)
    rows = [(i, ("w | " if r.random() < 0.3 else "w v ") * r.randrange(1, 60), r.choice(["en", "en", "en", "de"]), r.choice(["big", "big", "big", "mid", "low"])) for i in range(600)]
    rows = [(i, t + r.choice([" alpha", " beta beta", ""]) * (r.random() < 0.4), la, s) for i, t, la, s in rows]
    table = docs(rows)
    rates = mixing.cell_rates(mixing.measured(table)).collect()
    total = sum(c["tokens"] for c in rates)
    for dim, power in mixing.POWERS.items():
        own, goal = Counter(), Counter()
        for c in rates:
            own[c[dim]] += c["tokens"] * c["rate"]
            goal[c[dim]] += c["tokens"]
        scale = sum(x**power for x in goal.values())
        assert all(abs(own[k] / (total * x**power / scale) - 1) < 1e-3 for k, x in goal.items())
    got = mixing.probabilities(table).collect()
    assert abs(sum(x["tokens"] * x["prob"] for x in got) / total - mixing.BUDGET) < 0.01
    assert abs(sum(x["tokens"] for x in got if x["sampled"]) / total - mixing.BUDGET) < 0.1
    mixed = mixing.mix(table)
    named = mixing.mix(table.withColumnRenamed("rep", "PROB"))
    assert named.columns[-2:] == ["PROB", "prob_"] and {x["PROB"] for x in named.collect()} == {"extra"}
    assert mixed.columns == [*table.columns, "prob"] and mixed.count() == sum(x["sampled"] for x in got)


def test_raking_of_many_classes_to_given_targets(spark, monkeypatch):
    """A hundred languages by a hundred topics, with targets of the caller; small probabilities stay."""
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-7)
    r = random.Random(3)
    rows = [(k, f"s{k % 7}", f"l{k % 100:02}", f"t{k // 100:02}", r.randrange(1, 500)) for k in range(10_000)]
    rows.append((10_000, "s0", "l00", "rare", 1))
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    targets = {"lang": {f"l{k:02}": k + 1 for k in range(100)}, "topic": {**{f"t{k:02}": 100 - k for k in range(100)}, "rare": 1e-7}}
    rates = mixing.cell_rates(table, targets).collect()
    total = sum(c["tokens"] for c in rates)
    for dim, weights in targets.items():
        own = Counter()
        for c in rates:
            own[c[dim]] += c["tokens"] * c["rate"]
        assert all(own[k] / total == pytest.approx(w / sum(weights.values()), rel=1e-5) for k, w in weights.items())
    assert all(c["rate"] > 0 for c in rates)


def test_contradicting_targets_are_reported(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 5)
    table = spark.createDataFrame([(1, "a", "x", "t", 10), (2, "b", "y", "t", 10)], "doc_id long, source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="not met"):
        mixing.cell_rates(table, {"source": {"a": 1, "b": 1}, "lang": {"x": 9, "y": 1}})
    with pytest.raises(ValueError, match="no class"):
        mixing.cell_rates(table, {"lang": {"z": 1}})


def test_topics_are_counted_by_their_terms(docs):
    rows = [(1, "The Market, the BANK and a price; one judge."), (2, "market court bank judge price loi"), (3, "market bank"), (4, "a|b|c | d |"), (5, "Musik! roman, gemälde"), (6, "HELLO THERE WORLD"), (7, "### $$$ word"), (8, ""), (9, None)]
    found = {x["doc_id"]: x["topic"] for x in mixing.measured(docs(rows)).collect()}
    assert found == {1: "economy", 2: "economy", 3: "general", 4: "table", 5: "arts", 6: "shouted", 7: "markup", 8: "empty", 9: "empty"}


def test_mixing_edges(docs, edges, empty):
    got = mixing.probabilities(edges).collect()
    assert len(got) == edges.count() and all(0 <= x["prob"] <= 1 for x in got)
    assert {x["topic"] for x in got if (x["doc_id"] or 9) < 4} == {"empty"} and not any(x["sampled"] for x in got if x["doc_id"] is None)
    assert mixing.probabilities(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.probabilities(docs([(1, None), (2, "")])).where("sampled").count() == 0


def test_sampling_follows_the_probability(spark):
    from pyspark.sql import functions as F

    from tideline.llm.common import stable_unit

    mean, low = spark.range(20000).select(stable_unit(F.col("id"), "s").alias("u")).agg(F.avg("u"), F.avg((F.col("u") < 0.3).cast("int"))).first()
    assert mean == pytest.approx(0.5, abs=0.01) and low == pytest.approx(0.3, abs=0.02)


SAMPLES = {
    "email": ["a@b.io"],
    "phone": ["+1 (017) 555-7713", "017-555-7713"],
    "ip": ["8.8.8.8", "1.1.1.1", "10.20.30.40"],
    "card": ["4111111111111111", "4111 1111 1111 1111"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000"],
    "ip6": ["fe80::1", "2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329", "::1"],
    "address": ["12 Main Street", "7 Hauptstraße".split()[1] + " 7", "5 rue de la Paix", "Calle Mayor 3"],
    "name": [f"{t.replace('[', '').split(']')[0][0] + t.split(']')[1] if ']' in t else t} Aba" for titles in pii.TITLES.values() for t in titles.split("|")],
}


def test_each_sample_alone_is_found(docs):
    """The prefilter passes every text that a single pattern matches."""
    rows = [(k, f"see {e} ok", kind) for k, (kind, e) in enumerate((kind, e) for kind, v in SAMPLES.items() for e in v)]
    got = {r["doc_id"]: r for r in pii.pseudonymize(docs(rows)).collect()}
    for k, text, kind in rows:
        assert got[k][f"n_{kind}"] == got[k]["n_entities"] == 1 and got[k]["text"] != text, text


WIDE = {
    "ip6": ["fe80::1", "2001:DB8::FF00:42:8329", "1:2:3:4:5:6:7:8"],
    "address": ["12 Main Street", "1600 Old Mill Road", "Hauptstraße 12a", "12 bis rue de l'Église", "Avenida de la Paz 34"],
    "phone": ["(555) 123-4567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+15551234567", "+49 (30) 1234567", "0044 20 7946 0958", "020 7946 0958", "030/1234 5678"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "BE68 5390 0754 7034", "NO93 8601 1117 947"],
    "name": ["Mr. John Paul Smith", "Ms Smith-Jones", "Mr McDonald", "Mrs O'Brien", "Dr. Ada van der Berg", "Herr Prof. Dr. Max Karl Emil Weiß", "Mr. J. R. Smith", "Prof. J.-P. D’Arc", "Anna Schmidt", "Michael van Dyke", "My name is Zed Quux"],
}


def test_wide_forms_are_replaced_whole(docs):
    """All of the entity is replaced, nothing around it, and marks and titles stay."""
    rows = [(k, f"see {e}, ok", kind) for k, (kind, e) in enumerate((kind, e) for kind, v in WIDE.items() for e in v)]
    rows += [(100, "AB12 THIS LAND IS YOUR LAND; Mr. Smith's dog. Then BE68 5390 0754 7034 IS VALID", ""), (101, "+1 (555) 123-4567 DE89370400440532013000 555-123-4567", "")]
    rows.append((102, "Mr" + " Aa" * 30000 + " A.-B." * 9000 + " x", ""))
    got = {r["doc_id"]: r for r in pii.pseudonymize(docs(rows)).collect()}
    for k, text, kind in rows[:-3]:
        old, new = text[4:-4], got[k]["text"][4:-4]
        assert got[k][f"n_{kind}"] == got[k]["n_entities"] == 1 and got[k]["text"] == f"see {new}, ok", text
        if kind == "name":
            words = lambda t: set(re.findall(r"[^\W\d_]{2,}", t)) - {"Mr", "Mrs", "Ms", "Dr", "Herr", "Prof", "van", "der", "My", "name", "is"}
            assert not words(old) & words(new) and (new.split()[0] == old.split()[0] or old[:4] in ("Anna", "Mich")), text
        elif kind == "address":
            assert new != old and not set(re.findall(r"[A-ZÀ-Þ]\w{2,}", old)) & set(re.findall(r"[A-ZÀ-Þ]\w{2,}", new)) - {"Street", "Road", "Avenida"}, text
        else:
            shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
            assert shape(new) == shape(old) and new != old, text
    out = {text[4:-4]: got[k]["text"][4:-4] for k, text, _ in rows[:-3]}
    assert out["+44 20 7946 0958"][:4] == "+44 " and out["+33 1 23 45 67 89"][:4] == "+33 "
    assert re.fullmatch(r"AB12 THIS LAND IS YOUR LAND; Mr\. \w+'s dog\. Then BE\d\d( \d{4}){3} IS VALID", got[100]["text"]) and "Smith" not in got[100]["text"]
    plus, iban, plain = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) (DE\d{20}) (\d{3}-\d{3}-\d{4})", got[101]["text"]).groups()
    same = lambda t: re.sub(r"\W", "", t)
    assert same(out["+15551234567"]) == same(plus) == "1" + same(plain) and same(out["(555) 123-4567"]) == same(plain)
    assert same(out["0044 20 7946 0958"]) == "00" + same(out["+44 20 7946 0958"])
    assert same(out["DE89 3704 0044 0532 0130 00"]) == iban
    assert (got[102]["n_name"], got[102]["text"][-2:]) == (1, " x")


def test_full_forms_get_distinct_surrogates(spark):
    """All users of one letter and one digit within domains, and all numbers of a short form."""
    users = [("email", f"{a}@{d}") for d in ("one.io", "two.io", "x.de", "y.de") for a in "abcdefghijklmnopqrstuvwxyz0123456789"]
    phones = [("phone", f"+290{k:04}") for k in range(10000)] + [("phone", "0175557713"), ("phone", "+29112345")]
    real = users + phones + [("name", "m:J."), ("name", "m:K.")] + [("name", f"f:{c}.") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    got = pii.mapping(spark.createDataFrame(real, "kind string, canon string")).collect()
    assert sorted((r["kind"], r["canon"]) for r in got) == sorted(real)
    assert len({(r["kind"], r["s"]) for r in got}) == len(real) and all(r["canon"] != r["s"] for r in got)
    assert not {(r["kind"], r["s"]) for r in got if not r["canon"].startswith("+290")} & set(real)
    assert all(re.fullmatch(r"\+290\d{4}", r["s"]) for r in got if r["canon"].startswith("+290"))


def test_lengthened_surrogates_are_rendered_whole(spark):
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 'email' AS kind, 'A@One.io' AS e, 'qxb@kfd.io' AS s")
    assert row.select(pii.rendered(F.col("kind"), F.col("e"), F.col("s")).alias("t")).first()["t"] == "qxB@Kfd.io"
