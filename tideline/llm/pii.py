"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detected: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment cards (Luhn-valid
numbers only), ids of the form ddd-dd-dddd, IBANs (closed up or in fours), postal addresses of
street and number in four languages, and names after titles, after phrases such as `my name is`,
or that start with a common given name, with any number of parts. An entity's canonical form
(lower case, or digits alone) is mapped to a surrogate of the same form:

- digits go through a keyed Feistel permutation of their length, so distinct numbers stay
  distinct; country codes, a card's first digit and Luhn validity, and all marks are kept;
- IPv4 addresses go through one of their 32 bits, hexadecimal digits of IPv6 are replaced;
- letters and digits of e-mail addresses and IBANs are replaced by ones of their kind; an IBAN
  gets the check digits of its new number; a domain is an entity too, replaced alike wherever it
  occurs, its last label is kept;
- names are built from syllables of their script, their ending follows the gender of the title
  or the given name; street names likewise, kinds of street are kept.

Equal entities get equal surrogates in all documents. Collision checks: a surrogate that is
some real entity of the table, or that another entity has, is drawn again with another salt.
After four draws, domains, e-mail users, names and streets grow with each further one, so that
the space of surrogates outgrows any table. Where numbers of one form are so dense that twelve
draws fail, the entities of that form exchange their values. No table is refused.

Scale: texts are scanned once; rows with candidates are written to the shared folder, others
pass. The mapping is built per distinct entity after partial aggregation. An entity that is
in a third of all rows meets its one mapping row in a join that AQE can split. Entities of a
document return as one list, as long as the document holds entities. No pattern repeats a
group without a bound or without possession, so texts of any length need a bounded stack.

Defined cases: null text stays null; text without entities is unchanged; texts of any length are
taken whole; rows of equal doc_id are treated one by one; an empty table gives no rows; other
columns are kept as they are. The key is a parameter, else the session's setting KEY_SETTING;
the constant KEY serves only where there is neither, since surrogates under a public key can be
found out by trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut, passing_cuts
from tideline.llm.exprs import let, total

KEY, KEY_SETTING = "tideline-surrogates", "spark.tideline.surrogateKey"
KINDS = ("email", "phone", "ip", "ip6", "card", "ssn", "iban", "address", "name")
#: Kinds whose surrogates may grow.
GROWING = ("email", "name", "address", "domain")
TITLES = {"m": r"Mr|Herr|Monsieur|Señor|Sr|г-н", "f": r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа", "n": r"Dr|Doctor|Prof|Professor|Mx|д-р|проф|[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es"}
TITLE = "|".join(TITLES.values())
#: Common given names that are no other words; capitalised words after one are a name without a title.
GIVEN = {
    "f": "Anna Barbara Carmen Caroline Catherine Charlotte Christine Claudia Deborah Elena Elizabeth Emily Emma Gabriele Hannah Heike Isabel Jennifer Jessica Julia Karin Katharina Kimberly Laura Linda Lisa Lucia Margaret Maria Marie Martina Melissa Michelle Monika Nancy Nathalie Nicole Olivia Patricia Petra Rachel Rebecca Renate Sabine Samantha Sandra Sarah Sophie Stephanie Susan Susanne Ursula Valérie Victoria",
    "m": "Alexander Andreas Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Diego Edward Fernando Francisco François Frank Friedrich George Günther Hans Harold Heinrich Henry Jacques James Javier Jean Jeffrey Johannes John Jonathan José Joseph Joshua Juan Jürgen Karl Kenneth Kevin Klaus Lukas Manuel Matthew Michael Miguel Nicholas Pablo Patrick Paul Pedro Peter Philippe Richard Robert Ronald Samuel Sebastian Stefan Steven Thomas Timothy Wilhelm William Wolfgang",
}


def trie(words: list[str]) -> str:
    """An alternation of words by their first letter."""
    first = sorted({w[0] for w in words})
    return "|".join(c + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True)) + ")" for c in first)


GIVEN_NAME = {g: trie(names.split()) for g, names in GIVEN.items()}
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A domain has at most 127 labels by its standard; the bound keeps the stack small.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,24}"
PHONE = "|".join((
    r"(?<![\w.+])\+?\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    r"\((?<![\w.+]\()\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?:\+(?<![\w.+]\+)|00(?<![\w.+-]00))[1-9]\d{0,2}[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d(?:[ ./-]?\d){5,11}(?!\d)",
    r"(?<![\w.+/-])0\d{1,4}[ /-]\d{3,4}[ -]\d{3,5}(?![\w-])",
))
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,40}[0-9])(?=[0-9A-Fa-f:]{0,40}::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:]|\.\w)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Country codes by the length of their IBANs, for the form printed in fours (registry of the standard).
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
IN_FOURS = "|".join(rf"(?:{c})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|(?=[A-Z]{{2}}\d{{2}} )(?:{IN_FOURS}))(?![A-Za-z0-9])"
#: Loops of groups are possessive: those need no stack in Java, however long the text.
WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:(?:['’](?!s(?!\p{L}))|[-‐‑])[\p{L}\p{M}]++)*+"
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "zu", "zum", "zur", "y")
PART = rf"(?:(?:{'|'.join(PARTICLES)}) )*+(?:\p{{Lu}}\.(?:[ -]?\p{{Lu}}\.)*+(?:[ -]?{WORD})?+|{WORD})"
NAME = rf"(?<!\p{{L}})(?:(?:(?:{TITLE})\.? )++{PART}|(?=\p{{Lu}})(?:{'|'.join(GIVEN_NAME.values())}) {PART})(?: {PART})*+"
STREET = {"en": r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Way|Place", "de": r"straße|strasse|str\.|weg|platz|allee|gasse", "fr": r"rue|avenue|boulevard|place|chemin|allée|impasse|quai", "es": r"Calle|Avenida|Avda\.|Plaza|Paseo"}
JOINS = r"de|du|des|del|la|le|les|los|las|bis|ter"
PLACE = rf"(?:(?:{JOINS}) |[ld]['’])*+{WORD}(?: {WORD})*+"
ADDRESS = "|".join((
    rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:{WORD} ){{1,4}}(?:{STREET['en']})(?!\p{{L}})",
    rf"(?<!\p{{L}})\p{{Lu}}[\p{{L}}-]*?(?:{STREET['de']}) \d{{1,4}}[a-z]?(?!\w)",
    rf"(?<![\w.-])\d{{1,4}}(?: bis| ter)?,? (?:{STREET['fr']}) {PLACE}",
    rf"(?<!\p{{L}})(?:{STREET['es']}) {PLACE},? \d{{1,4}}(?!\w)",
))
PATTERN = "|".join((EMAIL, PHONE, IP, IP6, CARD, SSN, IBAN, ADDRESS, NAME))
#: Found in every text that PATTERN matches.
LIKELY = rf"[@0-9]|(?:{TITLE})\.? |(?=\p{{Lu}})(?:{'|'.join(GIVEN_NAME.values())}) "
#: Country codes of telephone numbers; all others have three digits.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CONSONANTS, VOWELS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдзклмнпрст"}, {"latin": "aeiou", "cyrillic": "аеиоу"}
#: Draws at the surrogate's own length; then those of GROWING kinds grow by a letter or syllable
#: a draw, until all are free. Other kinds have a fixed length and MAX_SALTS draws.
OWN_LENGTH, MAX_SALTS, SYLLABLES = 4, 12, 4


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; doubled: parity, from the right, of the digits that count twice."""
    each = F.transform(F.reverse(F.split(d, "")), lambda c, i: let(F.try_to_number(c, F.lit("9")).cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return total(each)


def kind_of(e: Column) -> Column:
    """The kind of a match of PATTERN; null for a number that is no card."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(e.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f]*$"), "ip6")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
        .when(e.rlike(r"[0-9]") & e.rlike(r"\p{L}"), "address")
        .when(e.rlike(r"^\p{L}"), "name")
        .when(e.rlike(r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})$"), F.when(luhn_sum(digits(e), 1) % 10 == 0, "card"))
        .otherwise("phone")
    )


def canonical(kind: Column, e: Column) -> Column:
    name = F.regexp_replace(e, rf"^(?:(?:{TITLE})\.? )++", "")
    marked = lambda g: e.rlike(rf"^(?:(?:{TITLES['n']})\.? )*(?:(?:{TITLES[g]})\.? |(?:{GIVEN_NAME[g]}) )")
    gender = F.when(marked("f"), "f:").when(marked("m"), "m:").otherwise("n:")
    plus = lambda d: F.when(e.startswith("00"), F.concat(F.lit("+"), F.substring(d, F.lit(3), F.length(d)))).when(e.startswith("+") | (F.length(d) > 10), F.concat(F.lit("+"), d)).otherwise(d)
    return F.when(kind.isin("email", "ip6"), F.lower(e)).when(kind == "phone", let(digits(e), plus)).when(kind.isin("card", "ssn"), digits(e)).when(kind == "name", F.concat(gender, name)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)


def keyed(key: str, salt: Column, *parts: Column) -> Column:
    """48 keyed bits of the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), salt.cast("string"), *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, top: Column, low: Column, key: str, salt: Column, tag: str) -> Column:
    """A keyed permutation of pairs (left < top, right < low), as an array of two."""

    def turn(r: int):
        mask = lambda x: keyed(key, salt, F.lit(f"{tag}{r}"), x.cast("string"))
        if r % 2:
            return lambda s: F.array(s[0], F.pmod(s[1] + mask(s[0]), low))
        return lambda s: F.array(F.pmod(s[0] + mask(s[1]), top), s[1])

    state = F.array(left, right)
    for r in range(4):
        state = let(state, turn(r))
    return state


def permuted(d: Column, key: str, salt: Column, tag: str) -> Column:
    """A keyed permutation of the digit strings of each length up to 18."""

    def run(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        number = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("0")).cast("long")
        pair = feistel(number(F.substring(d, F.lit(1), a)), number(F.substring(d, a + 1, n - a)), power(a), power(n - a), key, F.concat_ws(".", salt.cast("string"), n.cast("string")), tag)
        return let(pair, lambda p: F.concat(F.lpad(p[0].cast("string"), a, "0"), F.lpad(p[1].cast("string"), n - a, "0")))

    return let(d, run)


def substituted(x: Column, key: str, salt: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by a keyed one of its kind; hexadecimal: of its kind below g."""

    def swap(c: Column, h: Column) -> Column:
        if hexadecimal:
            return F.when(c.rlike("[a-f]"), F.char(F.pmod(h, F.lit(6)) + 97)).when(c.rlike("[0-9]"), F.char(F.pmod(h, F.lit(10)) + 48)).otherwise(c)
        return F.when(c.rlike("[a-z]"), F.char(F.pmod(h, F.lit(26)) + 97)).when(c.rlike("[A-Z]"), F.char(F.pmod(h, F.lit(26)) + 65)).when(c.rlike("[0-9]"), F.char(F.pmod(h, F.lit(10)) + 48)).otherwise(c)

    def run(s: Column) -> Column:
        return F.array_join(F.transform(F.split(x, ""), lambda c, i: let(F.pmod(F.xxhash64(s, i), F.lit(780)), lambda h: swap(c, h))), "")

    return let(keyed(key, salt, seed), run)


def syllables(part: Column, gender: Column, key: str, salt: Column, extra: int = 0) -> Column:
    """A name of SYLLABLES and extra syllables in the script of part, with an ending of its gender."""

    def build(script: str) -> Column:
        c, v = F.lit(CONSONANTS[script]), F.lit(VOWELS[script])
        nc, nv = len(CONSONANTS[script]), len(VOWELS[script])

        def run(h: Column) -> Column:
            pick = lambda s, n, shift: F.substring(s, (F.pmod(F.xxhash64(h, F.lit(shift)), F.lit(n)) + 1).cast("int"), F.lit(1))
            body = F.concat(*[F.concat(pick(c, nc, 2 * k), pick(v, nv, 2 * k + 1)) for k in range(SYLLABLES + extra)])
            end = F.when(gender == "f", {"latin": "na", "cyrillic": "на"}[script]).when(gender == "m", {"latin": "n", "cyrillic": "н"}[script]).otherwise({"latin": "r", "cyrillic": "р"}[script])
            return F.initcap(F.concat(body, end))

        return let(keyed(key, salt, gender, part), run)

    return F.when(part.rlike(r"\p{IsCyrillic}"), build("cyrillic")).otherwise(build("latin"))


def name_part(part: Column, gender: Column, key: str, salt: Column, extra: int = 0) -> Column:
    """The surrogate of one part of a name: particles stay, initials stay initials, hyphens stay."""
    whole = F.array_join(F.transform(F.split(part, "[-‐‑]"), lambda q: syllables(q, gender, key, salt, extra)), "-")
    initial = F.concat(F.substring(syllables(part, gender, key, salt), 1, 1), F.lit("."))
    return F.when(part.isin(*PARTICLES), part).when(part.rlike(r"^\p{Lu}\.$") & F.lit(not extra), initial).otherwise(whole)


def street_part(part: Column, key: str, salt: Column, extra: int) -> Column:
    """The surrogate of one word of a postal address: numbers, kinds of street and small words keep their place."""
    number = substituted(part, key, salt, F.concat(F.lit("number:"), part))
    compound = F.regexp_extract(part, rf"(?:{STREET['de']}),?$", 0)
    mark = F.regexp_extract(part, "[,.]+$", 0)
    kept = rf"^(?:{STREET['en']}|{STREET['fr']}|{STREET['es']}|{JOINS})[,.]?$"
    named = F.concat(syllables(part, F.lit("n"), key, salt, extra), mark)
    return F.when(part.rlike("^[0-9]"), number).when(part.rlike(kept), part).when(compound != "", F.concat(syllables(part, F.lit("n"), key, salt, extra), compound)).otherwise(named)


def check_digits(country: Column, number: Column) -> Column:
    """Check digits of an IBAN: 98 minus the rest modulo 97 of number, country and two zeros."""
    fold = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))).when(c.rlike("[A-Z]"), r * 100 + F.ascii(c) - 55).otherwise(r) % 97
    rest = F.aggregate(F.split(F.concat(number, country, F.lit("00")), ""), F.lit(0), fold)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def surrogate(kind: Column, canon: Column, salt: Column, key: str, extra: int = 0, domain: Column | None = None) -> Column:
    """The canonical surrogate of a canonical entity, longer by extra where its kind grows.

    domain is the surrogate of an e-mail address's domain.
    """
    n = F.length(canon)
    code = F.regexp_extract(canon, COUNTRY, 0)
    phone = F.concat(code, permuted(F.substring(canon, F.length(code) + 1, n), key, salt, "phone"))
    stem = F.concat(F.substring(canon, F.lit(1), F.lit(1)), permuted(F.substring(canon, F.lit(2), n - 2), key, salt, "card"))
    card = let(stem, lambda s: F.concat(s, F.pmod(-luhn_sum(s, 0), F.lit(10)).cast("string")))
    octet = lambda k: F.get(F.split(canon, r"\."), F.lit(k)).cast("long")
    ip = let(feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, salt, "ip"), lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(p[0] / 256), p[0] % 256, F.floor(p[1] / 256), p[1] % 256)]))
    more = substituted(F.lit("x" * extra), key, F.concat_ws(".", salt.cast("string"), F.lit("more")), canon) if extra else F.lit("")
    top = F.substring_index(canon, ".", -1)
    host = F.concat(more, substituted(F.substring(canon, F.lit(1), n - F.length(top)), key, salt, canon), top)
    email = F.concat(more, substituted(F.substring_index(canon, "@", 1), key, salt, canon), F.lit("@"), F.lit("") if domain is None else domain)
    country = F.substring(canon, 1, 2)
    iban = let(substituted(F.substring(canon, F.lit(5), n), key, salt, canon), lambda x: F.concat(country, check_digits(country, x), x))
    gender = F.substring(canon, 1, 1)
    name = F.concat(F.substring(canon, 1, 2), F.array_join(F.transform(F.split(F.substring(canon, F.lit(3), n), " "), lambda p: name_part(p, gender, key, salt, extra)), " "))
    address = F.array_join(F.transform(F.split(canon, " "), lambda p: street_part(p, key, salt, extra)), " ")
    out = F.when(kind == "email", email).when(kind == "domain", host).when(kind == "phone", phone).when(kind == "ssn", permuted(canon, key, salt, "ssn")).when(kind == "card", card).when(kind == "ip", ip)
    return out.when(kind == "ip6", substituted(canon, key, salt, canon, True)).when(kind == "iban", iban).when(kind == "address", address).otherwise(name)


def rendered(kind: Column, e: Column, s: Column) -> Column:
    """A canonical surrogate in the format of the entity as it stands in the text."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    fill = lambda s, held: F.aggregate(F.split(e, ""), start, lambda a, c: F.when(c.rlike(held), F.struct(F.concat(a["out"], F.substring(s, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))))["out"]
    access = F.when((kind == "phone") & e.startswith("00"), "00").otherwise("")
    filled, grouped = fill(F.concat(access, F.ltrim(s, F.lit("+"))), "[0-9]"), fill(s, "[A-Z0-9]")
    more = F.length(s) - F.length(e)
    letter = lambda i: F.substring(s, i + more + 1, F.lit(1))
    cased = F.concat(F.substring(s, F.lit(1), more), F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(letter(i))).otherwise(letter(i))), ""))
    title = F.regexp_extract(e, rf"^(?:(?:{TITLE})\.? )++", 0)
    return F.when(kind.isin("email", "ip6"), cased).when(kind.isin("phone", "card", "ssn"), filled).when(kind == "name", F.concat(title, F.substring(s, F.lit(3), F.length(s)))).when(kind == "iban", grouped).otherwise(s)


def form(kind: Column, canon: Column) -> Column:
    """What the surrogates of a kind of fixed length keep: entities of unlike forms never collide."""
    size = F.length(canon).cast("string")
    phone = F.concat(F.regexp_extract(canon, COUNTRY, 0), F.lit(":"), size)
    iban = F.concat(F.substring(canon, 1, 2), F.regexp_replace(F.regexp_replace(F.substring(canon, F.lit(5), F.length(canon)), "[0-9]", "9"), "[A-Z]", "A"))
    hexes = F.regexp_replace(F.regexp_replace(canon, "[0-9]", "9"), "[a-f]", "a")
    return F.when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ip6", hexes).when(kind == "card", F.concat(F.substring(canon, 1, 1), F.lit(":"), size)).when(kind == "ip", "").otherwise(size)


def exchanged(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, s) of full forms: each entity gets the next one of its form, in keyed order."""
    order = Window.partitionBy("kind", "form").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "canon"), 256), "canon")
    after, first = F.lead("canon").over(order), F.first("canon").over(order)
    return entities.select("kind", "canon", F.coalesce(after, first).alias("s"))


def mapping(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, s): the surrogate of each distinct entity, without collisions.

    Where real entities fill a form of fixed length so far that draws still fail, the entities of
    that form exchange their values: distinct, and none keeps its own, though each is a real one.
    """
    real = cut(entities.select("kind", "canon").distinct())
    emails = real.where("kind = 'email'").withColumn("d", F.substring_index("canon", "@", -1))
    if emails.isEmpty():
        return _drawn(real.withColumn("domain", F.lit("")), key)
    domains = _drawn(emails.select(F.lit("domain").alias("kind"), F.col("d").alias("canon"), F.lit("").alias("domain")).distinct(), key)
    named = emails.join(domains.select(F.col("canon").alias("d"), F.col("s").alias("domain")), "d").select("kind", "canon", "domain")
    return _drawn(cut(named.unionByName(real.where("kind <> 'email'").withColumn("domain", F.lit("")))), key)


def _drawn(real: DataFrame, key: str) -> DataFrame:
    """(kind, canon, s) of the distinct entities (kind, canon, domain)."""
    growing = ", ".join(f"'{k}'" for k in GROWING)
    taken, open_, salt = None, real, 0
    while True:
        drawn = cut(open_.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.lit(salt), key, max(0, salt - OWN_LENGTH + 1), F.col("domain"))))
        first = drawn.groupBy("kind", "s").agg(F.min("canon").alias("canon"))
        good = first.join(real.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "s"), ["kind", "s"], "left_anti")
        good = good.select("kind", "canon", "s")
        taken = cut(good if taken is None else taken.unionByName(good))
        open_ = cut(drawn.drop("s").join(taken.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        salt += 1
        if salt == MAX_SALTS:
            formed = lambda df: df.where(f"kind NOT IN ({growing})").withColumn("form", form(F.col("kind"), F.col("canon")))
            full = formed(open_).select("kind", "form").distinct()
            swapped = cut(exchanged(formed(real).join(full, ["kind", "form"], "left_semi"), key))
            taken = cut(taken.join(swapped, ["kind", "canon"], "left_anti").unionByName(swapped))
            open_ = open_.where(f"kind IN ({growing})")
        if open_.isEmpty():
            return taken


def session_key(docs: DataFrame, key: str | None) -> str:
    return key if key is not None else docs.sparkSession.conf.get(KEY_SETTING, KEY)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and `__tl_kinds`, the kinds of the entities in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("__tl_found", F.when(text.rlike(LIKELY), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    held = cut(marked.withColumn("__tl_row", F.monotonically_increasing_id()), result=True)
    plain = held.where(F.size("__tl_found") == 0).drop("__tl_row", "__tl_found").withColumn("__tl_kinds", F.array().cast("array<string>"))
    full = held.where(F.size("__tl_found") > 0)
    each = full.select("__tl_row", F.posexplode("__tl_found").alias("pos", "e")).withColumn("kind", kind_of(F.col("e")))
    each = cut(each.withColumn("canon", F.when(F.col("kind").isNotNull(), canonical(F.col("kind"), F.col("e")))))
    known = each.where("kind IS NOT NULL")
    named = known.join(mapping(known, key), ["kind", "canon"]).select("__tl_row", "pos", "kind", rendered(F.col("kind"), F.col("e"), F.col("s")).alias("s"))
    lists = cut(named.unionByName(each.where("kind IS NULL").select("__tl_row", "pos", "kind", F.col("e").alias("s"))).groupBy("__tl_row").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "s"))).alias("__tl_new")), result=True)
    parts = F.split("text", PATTERN, -1)
    rebuilt = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__tl_new"), i)["s"], F.lit("")))), "")
    kinds = F.filter(F.transform("__tl_new", lambda x: x["kind"]), lambda k: k.isNotNull())
    changed = full.join(lists, "__tl_row").withColumn("text", rebuilt).withColumn("__tl_kinds", kinds)
    return plain.unionByName(changed.select(*plain.columns))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_entities, n_<kind> of each kind) per row of docs."""
    with passing_cuts(docs.sparkSession):
        out = replace(docs.select(F.col("doc_id").cast("long"), "text"), session_key(docs, key))
    count = lambda k: F.size(F.filter("__tl_kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("__tl_kinds").cast("long").alias("n_entities"), *map(count, KINDS))


def clean(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in the texts; the same columns."""
    with passing_cuts(docs.sparkSession):
        out = replace(docs, session_key(docs, key))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
