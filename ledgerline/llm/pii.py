"""Personal data by weak supervision, in DataFrame functions only.

*Candidates.* Base patterns (e-mail, ip, card, phone) and wider ones (written-out e-mail, IPv6, national phone, social security
number, IBAN, title and name) give candidate spans; base matches that fail their test are candidates, too.

*Labelers.* Four labelers vote on each candidate - private, not private, or no vote: a *form* labeler (strict pattern or checksum), a
*gazetteer* (domains, reserved networks, issuers, calling codes, countries, given names), the *context* (cue words just before) and the
*edge* (what the span touches). For each kind, expectation-maximisation over how often each combination of votes
occurs estimates how reliable the labelers are and each combination's probability.

*Classifier.* A logistic model a kind is then fitted to these probabilities on eight attributes (the votes, shape, length, the character
before, digits in use). Spans that pass the base test always stay; others are added from ``LEAST`` on where they touch no base span.

Both fits see every candidate of the corpus, as counts of attribute combinations: at most some 7,000 a kind, whatever the corpus.

Positions are code points, ends exclusive. Repeats in patterns are possessive or fenced by what stands before, so a long run of
letters or digits is read once and needs no stack.

Defined results: null text counts as empty and has no spans. Repeated rows are results of their own, as are null doc_ids. An empty table
gives no rows. Contexts reach back to the candidate before at most.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
BASE_KINDS = 4
ATTRIBUTES = 8  # two bits each in a candidate's code; the first four are votes
NO, YES, NONE = 0, 1, 2
LEAST = 0.9
BEFORE, AFTER = 40, 4
CHUNK = 256

#: Base patterns of the contract, with possessive repeats; a run is entered at its start, or where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Wider patterns, each with a cheap test that a text must pass first.
SPOKEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{](?:at|AT)[)\]}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[{](?:dot|DOT|punkt|point|punto)[)\]}]|\.) ?[A-Za-z0-9-]{1,63}+){1,8}+"
IPV6 = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
NATIONAL_PHONE = r"(?<![0-9A-Za-z+(.-])(?<![0-9] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])(?![ .-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?|Sra?)\.? \p{Lu}\p{Ll}{2,30}(?: \p{Lu}\p{Ll}{2,30})?(?!\p{L})"

#: Fixed values of the gazetteers: top-level domains, calling codes, countries with IBANs, given names.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|uk|us|ca|mx|ar|br|pt|nl|be|at|ch|se|no|dk|fi|pl|cz|ie|eu|ru|jp|cn|in|au"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|81|82|84|86|90|91|92|93|94|95|98|35[0-9]|42[013]|97[0-9]"
IBAN_COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"
GIVEN = "Anna|Maria|John|James|Mary|Robert|Michael|David|Peter|Paul|Thomas|Hans|Klaus|Jürgen|Sabine|Ursula|Jean|Pierre|Marie|Jacques|Sophie|Luis|José|Juan|Carlos|Carmen|Isabel|Elena|Laura|Martin"
#: Networks that belong to nobody, and the issuers' number ranges.
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[34][0-9]|25[0-5])\."
ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}|3(?:0[0-5]|[68][0-9])[0-9]{11})$"
#: Cue words before a span that speak for its kind, and against it.
CUES = {
    "email": (r"mail|contact|kontakt|write|schreib|correo|courriel|écri", r"user|git|ssh|scp"),
    "ip": (r"\bip\b|host|server|client|login|logged|address|adresse|dirección", r"version|release|section|chapter|kapitel|\bv$|§"),
    "card": (r"card|visa|master|amex|credit|karte|carte|tarjeta|kredit", r"order|invoice|isbn|ticket|tracking|serial|bestell|commande|pedido|\bid\b|\bref\b"),
    "phone": (r"phone|\btel|call|fax|mobil|anruf|appel|llam|whatsapp|handy", r"isbn|order|invoice|version|serial|\bid\b"),
    "ssn": (r"\bssn\b|social|security|seguridad|sociale", r"order|invoice|part|serial|date"),
    "iban": (r"iban|konto|account|bank|compte|cuenta", r"serial|order|licen[cs]e|key"),
    "name": (r"dear|geehrte|from|sign|sincerely|estimad|cher|grüß|contact|name", r"street|avenue|straße|calle"),
}


def _running(steps: Column) -> Column:
    """Sums of the values before each, in chunks, so that no long array is copied for each of its values."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))

    def sums(values: Column, start: Column, of) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + of(x))))

    inner = F.transform(chunks, lambda ch: sums(ch, F.lit(0), lambda x: x))
    outer = sums(inner, F.lit(0), lambda w: F.element_at(w, -1))
    return F.flatten(F.zip_with(inner, F.slice(outer, 1, F.size(inner)), lambda w, before: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: x + before)))


def _with_matches(df: DataFrame, text: str, name: str, pattern: str, able: Column, wanted) -> DataFrame:
    """Adds ``name``: the pattern's matches (start, end, value, before, after) as an array, of those that are ``wanted``.

    Text between matches and matches alternate, so their lengths give the positions.
    """
    p = F.lit(pattern)
    found, parts = f"_{name}_found", f"_{name}_parts"
    df = df.withColumn(found, F.when(able, F.regexp_extract_all(F.col(text), p, F.lit(0))))
    df = df.withColumn(parts, F.when(F.exists(found, wanted), F.split(F.col(text), pattern, -1)))
    pairs = F.zip_with(F.slice(F.col(parts), 1, F.size(found)), F.col(found), lambda part, m: F.length(part) + F.length(m))
    df = df.withColumn(f"_{name}_at", F.when(F.col(parts).isNotNull(), _running(pairs)))
    at = F.transform(F.col(found), lambda m, i: F.struct(
        (F.get(F.col(f"_{name}_at"), i) + F.length(F.get(F.col(parts), i))).alias("start"),
        (F.get(F.col(f"_{name}_at"), i) + F.length(F.get(F.col(parts), i)) + F.length(m)).alias("end"), m.alias("value"),
        F.lower(F.right(F.get(F.col(parts), i), F.lit(BEFORE))).alias("before"), F.left(F.get(F.col(parts), i + 1), F.lit(AFTER)).alias("after")))
    return df.withColumn(name, F.when(F.col(parts).isNotNull(), F.filter(at, lambda x: wanted(x["value"]))).otherwise(F.filter(at, lambda x: F.lit(False)))).drop(found, parts, f"_{name}_at")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 1 to 19 digits pass the checksum."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.floor(d * 2 / 10).cast("int") + d * 2 % 10)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether an account number passes the checksum: moved to the front, letters as two digits, rest 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def step(rest: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), (rest * 10 + ch.cast("int")) % 97).otherwise((rest * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), step) == 1


def _octets(value: Column) -> Column:
    """Whether all parts are 255 at most, however many zeros lead."""
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.left(bare, F.lit(3))).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """A labeler that says yes or no, or has no vote."""
    return F.when(yes, YES).when(no if no is not None else F.lit(False), NO).otherwise(NONE)


def _strict(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2,24}$"), YES).otherwise(NO)


def _code(kind: str, x: Column, form: Column, gazetteer: Column) -> Column:
    """A candidate's eight attributes in two bits each: form, gazetteer, context, edge; shape, length, character before, digits in use."""
    value, before, after = x["value"], x["before"], x["after"]
    pro, con = CUES[kind]
    context = _vote(before.rlike(pro) & ~before.rlike(con), before.rlike(con) & ~before.rlike(pro))
    edge = F.when(before.rlike(r"[\p{L}\p{N}@/:=_]$") | after.rlike(r"^[\p{L}\p{N}@/=_]"), NO).otherwise(NONE)
    shape = F.when(value.contains(" "), 1).when(value.contains("-"), 2).when(value.contains("."), 3).otherwise(0)
    size = F.length(value)
    length = F.when(size < 12, 0).when(size < 17, 1).when(size < 25, 2).otherwise(3)
    previous = F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike(r"[\p{L}\p{N}]$"), 2).otherwise(3)
    digits = F.length(_digits(value))
    used = F.when(digits == 0, 0).when(digits < 5, 1).when(F.size(F.array_distinct(F.split(_digits(value), ""))) < 5, 2).otherwise(3)
    return reduce(lambda total, a: total * 4 + a, [form, gazetteer, context, edge, shape, length, previous, used]).cast("int")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their text, and ``cands``: array of (kind, start, end, base, code), kinds numbered as in ``KINDS``."""
    kept = [c for c in docs.columns if c != text]
    # one struct keeps the input's columns apart, whatever their names
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]) if kept else F.struct(F.lit(0).alias("c"))
    df = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    t, always = F.col("_text"), lambda v: F.lit(True)
    df = df.withColumn("_digit", t.rlike("[0-9]"))
    sources = [
        ("_email", EMAIL, t.contains("@"), always),
        ("_spoken", SPOKEN_EMAIL, t.rlike(r"[(\[{](?:at|AT)[)\]}]"), always),
        ("_ip", IP, F.col("_digit") & t.rlike(r"[0-9]\.[0-9]"), always),
        ("_ip6", IPV6, F.col("_digit") & t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"), always),
        ("_card", CARD, F.col("_digit"), lambda v: F.length(_digits(v)).between(12, 19)),
        ("_phone", PHONE, t.contains("+") & F.col("_digit"), always),
        ("_national", NATIONAL_PHONE, F.col("_digit") & t.rlike("[0-9]{3}[ .-][0-9]{4}"), always),
        ("_ssn", SSN, F.col("_digit") & t.rlike("[0-9]-[0-9]{2}-[0-9]{4}"), always),
        ("_iban", IBAN, F.col("_digit") & t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), always),
        ("_name", NAME, t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?|Sra?)\.? \p{Lu}"), always),
    ]
    for name, pattern, able, wanted in sources:
        df = _with_matches(df, "_text", name, pattern, able, wanted)

    def made(column: str, kind: str, base, form, gazetteer) -> Column:
        return F.coalesce(F.transform(column, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base(x["value"]).alias("base"), _code(kind, x, form(x["value"]), gazetteer(x["value"])).alias("code"))), F.array())

    def plain(v: Column) -> Column:
        at = F.regexp_replace(v, r" ?[(\[{](?:at|AT)[)\]}] ?", "@")
        return F.regexp_replace(at, r" ?(?:[(\[{](?:dot|DOT|punkt|point|punto)[)\]}]|\.) ?", ".")

    def in_domains(v: Column) -> Column:
        return _vote(v.rlike(rf"(?i)\.(?:{DOMAINS})$"))

    never = lambda v: F.lit(False)
    nobody = lambda v: F.lit(NONE)
    n_digits = lambda v: F.length(_digits(v))
    groups = [
        made("_email", "email", always, _strict, in_domains),
        made("_spoken", "email", never, lambda v: _strict(plain(v)), lambda v: in_domains(plain(v))),
        made("_ip", "ip", _octets, lambda v: F.when(_octets(v), YES).otherwise(NO), lambda v: _vote(F.lit(False), v.rlike(RESERVED))),
        made("_ip6", "ip", never, lambda v: F.lit(YES), lambda v: _vote(v.rlike("^[23]"), v.rlike("(?i)^f"))),
        made("_card", "card", lambda v: _luhn(_digits(v)), lambda v: F.when(_luhn(_digits(v)), YES).otherwise(NO), lambda v: _vote(_digits(v).rlike(ISSUERS))),
        made("_phone", "phone", lambda v: n_digits(v).between(9, 15), lambda v: F.when(n_digits(v).between(9, 15), YES).otherwise(NO), lambda v: _vote(v.rlike(rf"^\+(?:{CALLING})"))),
        made("_national", "phone", never, lambda v: F.when(v.rlike(r"^\(|-[0-9]{4}$"), YES).otherwise(NO), nobody),
        made("_ssn", "ssn", never, lambda v: F.when(v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), YES).otherwise(NO), nobody),
        made("_iban", "iban", never, lambda v: F.when(_mod97(v), YES).otherwise(NO), lambda v: _vote(v.rlike(f"^(?:{IBAN_COUNTRIES})"), ~v.rlike(f"^(?:{IBAN_COUNTRIES})"))),
        made("_name", "name", never, lambda v: _vote(v.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}")), lambda v: _vote(v.rlike(rf" (?:{GIVEN})(?: |$)"))),
    ]
    return df.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(kept)], F.concat(*groups).alias("cands"))


# --- the two fits: over counts of codes, a bounded table


def _attributes(codes: np.ndarray) -> np.ndarray:
    """The eight attributes of each code."""
    return codes[:, None] >> (2 * np.arange(ATTRIBUTES - 1, -1, -1)) & 3


def label_probabilities(votes: np.ndarray, counts: np.ndarray, strength: float = 0.5, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each combination of votes, reliabilities[class, labeler, vote]) by expectation-maximisation.

    Labelers are independent given the class. Each starts, and is held by ``strength`` times as many counts as there are candidates, at
    voting rightly two and a half times as often as wrongly, the first (form) some six times or more: without that, the
    one informative labeler could be explained away.
    """
    prior = np.array([[0.5, 0.2, 0.3], [0.2, 0.5, 0.3]])[:, None, :].repeat(votes.shape[1], 1)
    prior[:, 0] = [[0.8, 0.15, 0.05], [0.05, 0.9, 0.05]]
    held = strength * counts.sum() + 10
    share, says, p = 0.5, prior, np.zeros(len(votes))
    for _ in range(rounds):
        log = np.log(says[:, np.arange(votes.shape[1]), votes]).sum(2) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(log[0] - log[1]))
        if np.abs(new - p).max(initial=0) < 1e-10:
            break
        p = new
        for y, weight in enumerate((counts * (1 - p), counts * p)):
            seen = np.stack([np.bincount(votes[:, j], weight, 3) for j in range(votes.shape[1])])
            says = says.copy()
            says[y] = (seen + held * prior[y]) / (weight.sum() + held)
        share = (counts @ p + held / 2) / (counts.sum() + held)
    return p, says


def fit_classifier(attributes: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights [1 + 8 * 4] of a logistic model of one-hot attributes, fitted to probabilities by Newton's method."""
    x = np.concatenate([np.ones((len(attributes), 1)), np.eye(4)[attributes].reshape(len(attributes), -1)], 1)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - q)) - ridge * w
        step = np.linalg.solve((x * (counts * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(found: DataFrame) -> np.ndarray:
    """Weights a kind of the span classifier, from all candidates; a kind without any accepts nothing."""
    cells = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.code").count().collect()
    weights = np.zeros((len(KINDS), 1 + 4 * ATTRIBUTES))
    weights[:, 0] = -30.0
    for kind in range(len(KINDS)):
        mine = sorted((r["code"], r["count"]) for r in cells if r["kind"] == kind)
        if mine:
            codes, counts = np.array([c for c, _ in mine]), np.array([float(n) for _, n in mine])
            attributes = _attributes(codes)
            p, _ = label_probabilities(attributes[:, :4], counts)
            weights[kind] = fit_classifier(attributes, p, counts)
    return weights


def classify(found: DataFrame, weights: np.ndarray, least: float = LEAST) -> DataFrame:
    """Replaces ``cands`` by ``base`` and ``spans``: arrays of (start, kind, end, probability), in order; spans holds base ones, too."""
    table_ = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])

    def probability(c: Column) -> Column:
        mine = F.get(table_, c["kind"])
        parts = [F.get(mine, F.shiftright(c["code"], 2 * (ATTRIBUTES - 1 - j)).bitwiseAND(F.lit(3)) + (1 + 4 * j)) for j in range(ATTRIBUTES)]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.get(mine, F.lit(0)))))

    def span(c: Column, p: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), p.alias("probability"))

    df = found.withColumn("base", F.array_sort(F.transform(F.filter("cands", lambda c: c["base"]), lambda c: span(c, F.lit(1.0)))))
    added = F.transform(F.filter("cands", lambda c: ~c["base"] & (probability(c) >= least)), lambda c: span(c, probability(c)))
    df = df.withColumn("_added", F.array_distinct(added))
    apart = F.filter("_added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return df.withColumn("spans", F.array_sort(F.concat("base", apart))).drop("cands", "_added")


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their text, with ``base`` and ``spans``; fitted on the same documents. Columns of these names are replaced."""
    found = materialise(candidates(docs.drop("cands", "base", "spans"), text), "cands")
    return classify(found, fit(found))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every ``documents`` text."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter(F.col("base.kind"), lambda x: x == KINDS.index(k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:BASE_KINDS]]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
