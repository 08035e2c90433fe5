"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, telephone numbers, card and social security numbers, bank accounts, IP addresses, keys
and passwords, and names after a title. Every different entity of all documents gets one surrogate, derived from a secret
key and the entity, of the same kind and format; names keep the gender of their title and their script.

Formatted entities (all but names) are permuted inside their own format: each sign keeps its class (digit, a to f, g to z,
capitals likewise), runs of 12 signs are numbers in mixed radix, and a keyed Feistel network with cycle walking, the step
to the next number and the network backwards map them one to one. So no two of a format share a surrogate, none stays as
it is, and no format runs out of values, however many of them occur. Names have no such space: they are generated, checked
over all documents, and where two would share one, or one would equal a name that occurs, all but one draw again.

Texts without entities are passed on where they lie; only those with some are joined with their surrogates. They are
put in by place (between the pieces that the pattern splits the text into), so nothing is replaced twice.
"""

from __future__ import annotations

import secrets
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
CARD = r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
#: A social security number, and a bank account (IBAN) with or without its spaces.
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
#: After a colon or an equals sign any value of six signs up to its last letter or digit is a secret; without one it has
#: letters and digits only, with a digit.
_NAMED = r"""(?i:\b(?:password|passwd|secret|token|api_?key)["']?)"""
SECRET = rf"""\bAKIA[0-9A-Z]{{16}}\b|{_NAMED}\s{{0,2}}[=:]\s{{0,2}}["']?[^\s"'<>]{{5,}}[A-Za-z0-9]|{_NAMED}\s{{1,2}}["']?(?=[A-Za-z]*+\d)[A-Za-z0-9]{{8,}}+"""
#: Titles by gender; a name follows after a space.
MALE = r"Mr|Herrn?|Monsieur|Señor|Sr|Г-н|Господин|господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Mme|Madame|Mlle|Señora|Sra|Г-жа|Госпожа|госпожа"
OTHER = r"Dr|Prof|Д-р|Проф"
#: A name: parts of letters joined by a hyphen or an apostrophe, as in Smith-Jones or O'Brien.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}++(?:[-'’]\p{Lu}\p{L}++)*+"
TITLE = rf"(?:{MALE}|{FEMALE}|{OTHER})"
PERSON = rf"(?<!\p{{L}}){TITLE}\.? {_NAME}(?: {_NAME})*+"
#: Second labels under which domains are registered, as in example.co.uk; they stay.
SECOND_LEVEL = "co|com|org|net|ac|gov|edu"
ENTITY = "|".join([EMAIL, PHONE, IP, SSN, IBAN, CARD, SECRET, PERSON])
#: A text without any of these has no entity.
HINT = rf"[0-9@]|{_NAMED}\s{{0,2}}[=:]|{TITLE}\.? \p{{Lu}}"
#: Session setting that holds the secret key; without it a key is drawn for the session, so nobody can redo the mapping.
KEY_SETTING = "spark.pitpanel.surrogates.key"
#: Signs that make one number, and rounds of the network. 20 ** 12 is below 2 ** 53.
CHUNK, ROUNDS = 12, 6
#: Steps of a cycle walk: fewer than 2 a + 1 of the a * a numbers lie outside; a longer walk (chance below 4 ** -32) is an error.
WALK = 64
NAMES = ("given_f", "given_m", "given_n", "surname")
#: Parts of generated names by script: beginnings and vowels of syllables; male names end in a consonant, female in a.
SYLLABLES = {
    "latin": (("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "gr", "st", "tr"), ("a", "e", "i", "o", "u"), "a", "n"),
    "cyrillic": (("б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ст", "тр", "гр", "бр"), ("а", "е", "и", "о", "у"), "а", "н"),
}


def found(text: Column) -> Column:
    """The entities of a text in order, as they stand."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(raw: Column) -> Column:
    return (
        F.when(raw.rlike(rf"^{EMAIL}$"), "email")
        .when(raw.rlike(rf"^{TITLE}\.? \p{{Lu}}"), "person")
        .when(raw.startswith("+"), "phone")
        .when(raw.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(raw.rlike(rf"^{SSN}$"), "ssn")
        .when(raw.rlike(rf"^{IBAN}$") & ~raw.startswith("AKIA"), "iban")
        .when(raw.rlike(r"^\d[\d -]*$"), "card")
        .otherwise("secret")
    )


def value_of(raw: Column) -> Column:
    """The value of a secret: what follows its name, sign and quote; the whole of an access identifier."""
    return F.when(raw.startswith("AKIA"), raw).otherwise(F.regexp_replace(raw, rf"""^{_NAMED}\s{{0,2}}[=:]?\s{{0,2}}["']?""", ""))


def parts_of(raw: Column) -> Column:
    """The parts of an entity that get surrogates: array of (part, kind, norm). Names have one for each name, others one.

    norm is what makes two mentions the same entity: addresses in lower case, numbers by their digits, a secret by its
    value, a given name by gender, a surname alone (so that a name with and without given names agrees).
    """
    kind = kind_of(raw)
    names = F.split(F.regexp_replace(raw, rf"^{TITLE}\.? ", ""), " ")
    gender = F.when(raw.rlike(rf"^(?:{FEMALE})\.? "), "f").when(raw.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("n")

    def part(number, kind, norm):
        return F.struct(number.cast("int").alias("part"), kind.alias("kind"), norm.alias("norm"))

    persons = F.transform(names, lambda name, i: part(i, F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)), name))
    norm = (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "phone", F.concat(F.lit("+"), F.regexp_replace(raw, r"\D", "")))
        .when(kind.isin("card", "ssn"), F.regexp_replace(raw, r"\D", ""))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(kind == "ip", F.regexp_replace(raw, r"\b0+(?=\d)", ""))
        .when(kind == "secret", value_of(raw))
        .otherwise(raw)
    )
    return F.when(kind == "person", persons).otherwise(F.array(part(F.lit(0), kind, norm)))


def _stream(*what) -> Column:
    """128 hexadecimal digits from the key and what it is for."""
    text = F.concat_ws("|", *what)
    return F.concat(F.sha2(F.concat(text, F.lit("|0")).cast("binary"), 256), F.sha2(F.concat(text, F.lit("|1")).cast("binary"), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _low(c: Column) -> Column:
    """The first sign of the class of a sign."""
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-f]"), 97).when(c.rlike("[g-z]"), 103).when(c.rlike("[A-F]"), 65).when(c.rlike("[G-Z]"), 71).otherwise(0)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-fA-F]"), 6).when(c.rlike("[g-zG-Z]"), 20).otherwise(1).cast("long")


def _div(a: Column, b: Column) -> Column:
    """a div b of longs below 2**53, exactly."""
    return ((a - a % b) / b).cast("long")


def network(value: Column, side: Column, tweak: Column, backwards: bool) -> Column:
    """A keyed permutation of the numbers below side * side, or its inverse."""
    rounds = [F.lit(k) for k in range(ROUNDS)]

    def step(s, k):
        even = k % 2 == 0
        own, other = F.when(even, s["hi"]).otherwise(s["lo"]), F.when(even, s["lo"]).otherwise(s["hi"])
        noise = F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, k.cast("string"), other.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long") % side
        moved = (own + (side - noise if backwards else noise)) % side
        return common.let(moved, lambda m: F.struct(F.when(even, m).otherwise(s["hi"]).alias("hi"), F.when(even, s["lo"]).otherwise(m).alias("lo")))

    start = F.struct(_div(value, side).alias("hi"), (value % side).alias("lo"))
    return F.aggregate(F.array(*(reversed(rounds) if backwards else rounds)), start, step, lambda s: s["hi"] * side + s["lo"])


def moved_on(value: Column, size: Column, tweak: Column) -> Column:
    """The number that follows value in a keyed cycle through all numbers below size (2 or more): one to one, never value itself."""
    def on(side):
        def walk(v, backwards):
            again = lambda x: network(x, side, tweak, backwards)
            done = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), again(v), lambda x, _: F.when(x < size, x).otherwise(again(x)))
            return common.let(done, lambda x: F.when(x < size, x).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long")))

        return common.let(walk(value, False), lambda y: walk((y + 1) % size, True))

    return common.let(F.ceil(F.sqrt(size.cast("double"))).cast("long"), on)


def permuted(template: Column, tweak: Column) -> Column:
    """template with each sign replaced by one of its class, one to one over all strings of its classes; other signs stay.

    Runs of CHUNK signs are permuted one after the other, each under the classes and the plain text before it.
    """
    classes = F.translate(template, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "a" * 6 + "g" * 20 + "A" * 6 + "G" * 20)

    def run(k):
        chunk = F.substring(template, k * CHUNK + 1, F.lit(CHUNK))
        own = F.sha2(F.concat_ws("|", tweak, classes, k.cast("string"), F.substring(template, F.lit(1), k * CHUNK)).cast("binary"), 256)
        zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("n"))
        number = F.aggregate(F.split(chunk, ""), zero, lambda s, c: F.struct((s["v"] * _radix(c) + F.when(_radix(c) > 1, F.ascii(c) - _low(c)).otherwise(0)).alias("v"), (s["n"] * _radix(c)).alias("n")))

        def spelled(value):
            def sign(s, c):
                return F.struct(_div(s["v"], _radix(c)).alias("v"), F.concat(F.when(_radix(c) > 1, F.char(_low(c) + s["v"] % _radix(c))).otherwise(c), s["out"]).alias("out"))

            return F.aggregate(F.reverse(F.split(chunk, "")), F.struct(value.alias("v"), F.lit("").alias("out")), sign, lambda s: s["out"])

        return common.let(number, lambda x: F.when(x["n"] < 2, chunk).otherwise(common.let(moved_on(x["v"], x["n"], own), spelled)))

    runs = F.sequence(F.lit(0), F.ceil(F.length(template) / CHUNK).cast("int") - 1)
    return F.when(F.length(template) > 0, F.array_join(F.transform(runs, run), "")).otherwise(template)


def luhn_sum(digits: Column) -> Column:
    """The sum of the check-digit rule over a string of digits, the last one counting once."""
    n = F.length(digits)

    def value(c, i):
        d = c.cast("int") * (1 + (n - 1 - i) % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + b)


def session_key(spark: SparkSession) -> str:
    """The secret key of KEY_SETTING, or one drawn for this session and kept there."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def generated_name(norm: Column, stream: Column, gender: str | None, draw: Column | None = None) -> Column:
    """A name of three syllables, and one more for every eighth draw, in the script of norm, with the ending of the gender."""
    draw = F.lit(0) if draw is None else draw

    def of(script):
        onsets, vowels, female, male = SYLLABLES[script]
        pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), _byte(stream, i) % len(values) + 1)
        body = F.concat(*[F.concat(pick(onsets, F.lit(2 * k)), pick(vowels, F.lit(2 * k + 1))) for k in range(3)])
        more = F.transform(F.sequence(F.lit(0), F.floor(draw / 8).cast("int")), lambda k: F.when(k > 0, F.concat(pick(onsets, 2 * k + 8), pick(vowels, 2 * k + 9))).otherwise(""))
        body = F.initcap(F.concat(body, F.array_join(more, "")))
        if gender == "m":
            return F.concat(body, F.lit(male))
        stem = F.concat(body, pick(onsets[:14], F.lit(7)))
        return F.concat(stem, F.lit(female)) if gender == "f" else F.concat(stem, F.when((F.lit(script) == "cyrillic") & norm.endswith(female), female).otherwise(""))

    return F.when(norm.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def formatted(kind: Column, norm: Column, key: str) -> Column:
    """The surrogate of an entity with a format."""
    tweak = lambda *what: F.concat_ws("|", F.lit(key), kind, *what)
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    suffix = F.regexp_extract(domain, rf"((?:\.(?:{SECOND_LEVEL}))?\.[^.]+)$", 1)
    labels = F.split(F.substring(domain, F.lit(1), F.length(domain) - F.length(suffix)), r"\.")
    front = F.array_join(F.transform(labels, lambda label, k: permuted(label, tweak(F.array_join(F.slice(labels, k + 2, F.size(labels)), "."), suffix))), ".")
    email = F.concat(permuted(F.regexp_extract(norm, "^(.*)@", 1), tweak(domain)), F.lit("@"), front, suffix)
    octets = F.split(norm, r"\.")
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda v, o: v * 256 + o.cast("long"))
    ip = common.let(moved_on(address, F.lit(1 << 32).cast("long"), tweak()), lambda v: F.concat_ws(".", *[(F.shiftright(v, 24 - 8 * k).bitwiseAND(255)).cast("string") for k in range(4)]))
    code = F.regexp_extract(norm, r"^(\+1|\+7|\+\d{2})", 1)
    phone = F.concat(code, permuted(F.substring(norm, F.length(code) + 1, F.length(norm)), tweak(code)))
    # the last digit keeps its distance from the check digit, so valid numbers stay valid and others do not become so
    body = F.concat(F.substring(norm, 1, 1), permuted(F.substring(norm, F.lit(2), F.length(norm) - 2), tweak(F.substring(norm, 1, 1))))
    card = common.let(body, lambda b: F.concat(b, ((20 + luhn_sum(norm) % 10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    secret = F.when(norm.startswith("AKIA"), F.concat(F.lit("AKIA"), permuted(F.substring(norm, F.lit(5), F.length(norm)), tweak(F.lit("AKIA"))))).otherwise(permuted(norm, tweak()))
    iban = F.concat(F.substring(norm, 1, 2), permuted(F.substring(norm, F.lit(3), F.length(norm)), tweak(F.substring(norm, 1, 2))))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", permuted(norm, tweak())).when(kind == "iban", iban).otherwise(secret)


def drawn_name(kind: Column, norm: Column, draw: Column, key: str) -> Column:
    """The name that stands for a name at its draw-th attempt."""
    stream = _stream(F.lit(key), kind, norm, draw.cast("string"))
    return (
        F.when(kind == "given_f", generated_name(norm, stream, "f", draw)).when(kind == "given_m", generated_name(norm, stream, "m", draw)).otherwise(generated_name(norm, stream, None, draw))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, out for the different entities (kind, norm): no two of a kind share out; no name's is a name that occurs."""
    done = entities.filter(~F.col("kind").isin(*NAMES)).select("kind", "norm", formatted(F.col("kind"), F.col("norm"), key).alias("out"))
    names = open_ = entities.filter(F.col("kind").isin(*NAMES))
    taken = None
    for draw in count():
        if open_.isEmpty():
            return done
        drawn = common.materialize(open_.withColumn("out", drawn_name(F.col("kind"), F.col("norm"), F.lit(draw), key)), "drawn")
        every = drawn.select("kind", "norm", "out", F.lit(1).alias("fresh"))
        if taken is not None:
            every = every.unionByName(taken.select("kind", "norm", "out", F.lit(0).alias("fresh")))
        owner = every.groupBy("kind", "out").agg(F.min(F.struct("fresh", "norm")).alias("owner"))
        owner = owner.join(names.select("kind", F.col("norm").alias("out")), ["kind", "out"], "left_anti")
        mine = (F.col("owner.fresh") == 1) & (F.col("owner.norm") == F.col("norm"))
        judged = drawn.join(owner, ["kind", "out"], "left").select("kind", "norm", "out", F.coalesce(mine, F.lit(False)).alias("good"))
        judged = common.materialize(judged, "judged")
        settled = judged.filter("good").drop("good")
        done, taken = done.unionByName(settled), settled if taken is None else taken.unionByName(settled)
        open_ = judged.filter("NOT good").select("kind", "norm")


def poured(raw: Column, digits: Column) -> Column:
    """The digits and letters put in the places of those of raw."""
    state = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(s["out"], F.substring(digits, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))
        ),
    )
    return state["out"]


def written(raw: Column, outs: Column) -> Column:
    """The surrogate of a mention as it stands in a text: titles, prefixes and separators of the mention stay."""
    kind = kind_of(raw)
    value = F.length(value_of(raw))
    lead = F.when(kind == "person", F.regexp_extract(raw, rf"^({TITLE}\.? )", 1)).when(kind == "secret", F.substring(raw, F.lit(1), F.length(raw) - value)).otherwise("")
    out = F.array_join(outs, " ")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), poured(raw, F.regexp_replace(out, r"\W", ""))).otherwise(F.concat(lead, out))


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in text, and n_entities (mentions replaced; a column of that name is replaced).

    Whole texts. A null or empty text has no entities and stays as it is. Equal mentions get equal surrogates in all
    rows, repeated rows and rows that share a doc_id included. An empty table gives no rows; other columns stay. Without
    a key that of the session is taken (session_key).
    """
    key = key or session_key(docs.sparkSession)
    docs = docs.drop("n_entities")
    my_id, my_text, my_outs, my_put = common.free_names(docs.columns, "doc_id", "text", "outs", "put")
    plain = docs.filter(F.size(found(F.coalesce(F.col("text"), F.lit("")))) == 0).withColumn("n_entities", F.lit(0))
    bearing = docs.filter(F.size(found(F.coalesce(F.col("text"), F.lit("")))) > 0)
    # rows of one doc_id are told apart by their texts, so rows without a doc_id do not meet in one map
    row = [F.col("doc_id").cast("long").alias(my_id), F.xxhash64("text").alias(my_text)]
    mentions = bearing.select(*row, F.explode(F.array_distinct(found(F.col("text")))).alias("raw"))
    mentions = common.materialize(mentions.select(my_id, my_text, "raw", F.explode(parts_of(F.col("raw"))).alias("p")).select(my_id, my_text, "raw", "p.*"), "mentions")
    entities = common.materialize(mentions.select("kind", "norm").distinct(), "entities")
    outs = common.materialize(surrogates(entities, key), "surrogates")
    per_mention = mentions.join(outs, ["kind", "norm"]).groupBy(my_id, my_text, "raw").agg(F.sort_array(F.collect_set(F.struct("part", "out"))).alias("outs"))
    per_mention = per_mention.select(my_id, my_text, "raw", written(F.col("raw"), F.transform("outs", lambda o: o["out"])).alias("out"))
    per_doc = per_mention.groupBy(my_id, my_text).agg(F.map_from_entries(F.collect_list(F.struct("raw", "out"))).alias(my_outs))
    per_doc = common.materialize(per_doc, "per_doc")
    rows = bearing.join(per_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(my_id)) & (F.xxhash64("text") == F.col(my_text)))

    def put(pieces):
        return common.let(
            found(F.col("text")),
            lambda hits: F.struct(
                F.concat(
                    F.array_join(F.transform(hits, lambda hit, i: F.concat(pieces[i], F.element_at(F.col(my_outs), hit))), ""), F.element_at(pieces, -1)
                ).alias("text"),
                F.size(hits).alias("n"),
            ),
        )

    rows = rows.withColumn(my_put, common.let(F.split("text", ENTITY, -1), put))
    rows = rows.select(*[F.col(f"{my_put}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col(f"{my_put}.n").alias("n_entities"))
    return plain.unionByName(rows)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
