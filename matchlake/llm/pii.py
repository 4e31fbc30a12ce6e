"""Personal data by weak supervision, with DataFrame functions only.

Patterns give the base spans and further candidates. Labelers (shape, checksum, gazetteer, context, border) vote for,
against or not at all on each candidate. Expectation-maximisation on the counted vote patterns of each kind estimates
how reliable the labelers are and how likely each pattern is personal data. With these soft labels a naive Bayes span
classifier is trained on features of the span and its surroundings; it decides which candidates are added to the base
spans. Votes and features have few values, so the tables of patterns and weights are bounded whatever the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import fold, stored

#: Possessive forms match what the plain ones do without going back, so that no text costs more than its length; the
#: look-behinds keep a run from being tried again from its middle.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further kinds, by the first alternative that matches; their candidates count only if the classifier adds them.
MORE = {
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
    "mac": r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?:AKIA[A-Z0-9]{12,20}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"
    r"|(?i:password|passwd|pwd|secret|token|(?:api|access|private|auth)[_-]?key|bearer)[\x22']?\s{0,3}+[:=]{1,2}+>?\s{0,3}+[\x22']?[A-Za-z0-9+/_.=!@$%^*-]{6,}+)",
}
#: What stands before the value of a secret that is named; the span is the value.
NAMED = r"^(?:(?i:password|passwd|pwd|secret|token|(?:api|access|private|auth)[_-]?key|bearer)[\x22']?\s{0,3}+[:=]{1,2}+>?\s{0,3}+[\x22']?)"
#: What a text must hold for any of MORE to match.
MIGHT = r"[0-9]{3}|[=:]|AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"
KINDS = [*BASE, *MORE]
#: Words near a span that speak for its kind, words that speak against any, and gazetteers.
CUES = {
    "email": "mail|contact|write|e-mail|address|reply|send|schreib|correo|courriel|kontakt|escrib|adresse",
    "ip": r"\bip\b|host|server|login|client|serveur|servidor|address|adresse|router|proxy|gateway|dns|ping",
    "card": "card|visa|master|amex|credit|pay|debit|karte|carte|tarjeta|zahl|pago|cvv|expir",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|anruf|handy|appel|portable|llam",
    "iban": "iban|account|bank|konto|compte|cuenta|swift|bic|transfer",
    "local_phone": "phone|tel|call|fax|mobile|cell|anruf|appel|llam",
    "mac": r"\bmac\b|device|ethernet|wifi|wlan|adapter|interface|hardware",
    "national_id": "ssn|social|security|tax|passport|ident|insurance",
    "secret": "key|secret|password|passwd|pwd|token|credential|access|aws|auth|bearer|login|passwort|clave|mot de passe",
}
AGAINST = r"version|\bv[0-9]|isbn|issn|doi|page|figure|section|order|chapter|line|invoice|tracking|ticket"
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "info", "biz", "name", "pro", "app", "dev", "me", "tv", "co", "ai", "eu",
    "de", "fr", "es", "it", "uk", "us", "ch", "at", "nl", "be", "lu", "ie", "pt", "dk", "se", "no", "fi", "is", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "hr", "si", "rs", "ua", "ru", "ee", "lv", "lt", "tr",
    "mx", "ar", "br", "cl", "pe", "ve", "ec", "uy", "bo", "cr", "ca", "au", "nz", "jp", "cn", "kr", "tw", "hk", "sg", "in", "id", "my", "th", "vn", "ph", "za", "ng", "ke", "eg", "ma", "il", "ae", "sa",
)
#: Fixed value: country calling codes; those of three digits by their first two.
CALLING = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|85|88|96|97|99)[0-9])"
#: Fixed value: countries with IBANs, and the length of theirs.
IBANS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
NEAR = 30
LABELERS = ("shape", "checksum", "gazetteer", "context", "border")
ROUNDS = 20
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


#: Sums are run over blocks of about this many, so that no array grows by one element at a time for long.
RUN = 256
SPAN = "struct<start: int, end: int, value: string, before: string, after: string>"


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column) -> Column:
    """Running sums of an array that is not empty."""
    none = F.expr("cast(array() AS array<int>)")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda k: F.slice(steps, k * RUN + 1, F.lit(RUN)))

    def inside(at: Column, block: Column) -> Column:
        add = lambda a, s: F.struct((a["at"] + s).alias("at"), F.array_append(a["out"], a["at"] + s).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add)

    def step(acc: Column, block: Column) -> Column:
        return _let(inside(acc["at"], block), lambda done: F.struct(done["at"].alias("at"), F.array_append(acc["out"], done["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<array<int>>)").alias("out"))
    return F.aggregate(blocks, start, step, lambda acc: F.flatten(acc["out"]))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value, before, after>>, in code points.

    before and after are up to NEAR characters beside the match: of the text between it and the next match on that
    side, and where that is shorter, of that match and the text beyond it. The text is split once and each piece is
    looked at a few times, so that the time follows the text's length and the number of matches.
    """
    last = lambda c: F.substring(F.coalesce(c, F.lit("")), -NEAR, NEAR)
    first = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, NEAR)

    def spans(own: Column) -> Column:
        values, gaps = own["values"], own["gaps"]
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.length(g) + F.length(v)))
        heads, tails = F.transform(gaps, first), F.transform(gaps, last)

        def each(place: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                end = place["ends"][i]
                before = last(F.concat(F.coalesce(F.get(place["tails"], i - 1), F.lit("")), last(F.get(values, i - 1)), place["tails"][i]))
                after = first(F.concat(place["heads"][i + 1], first(F.get(values, i + 1)), F.coalesce(F.get(place["heads"], i + 2), F.lit(""))))
                return F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"), before.alias("before"), after.alias("after"))

            return F.transform(values, span)

        return _let(F.struct(ends.alias("ends"), heads.alias("heads"), tails.alias("tails")), each)

    pieces = lambda values: F.struct(values.alias("values"), F.split(text, pattern, -1).alias("gaps"))
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    return _let(F.regexp_extract_all(text, F.lit(f"({pattern})"), 0), lambda values: F.when(F.size(values) > 0, _let(pieces(values), spans)).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes; for strings of up to 19 digits."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the check digits of an IBAN are right: the first four characters behind the others, letters as 10 to 35."""
    turned = F.split(F.concat(F.substring(iban, 5, 30), F.left(iban, F.lit(4))), "")

    def step(rest: Column, c: Column) -> Column:
        return F.when(c == "", rest).when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def holds(kind: str, value: Column) -> Column:
    """What a match must hold besides its pattern to be a base span."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when(F.length(digits(value)).between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _votes(kind: Column, value: Column, before: Column, after: Column, base: Column) -> Column:
    """Votes of LABELERS: 1 for, 0 none, -1 against."""
    per = lambda parts, rest=F.lit(0): reduce(lambda out, k: F.when(kind == k, parts[k]).otherwise(out), parts, rest)
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    yes = lambda c: F.when(c, 1).otherwise(0)
    n = F.length(digits(value))
    variety = F.size(F.array_distinct(F.split(value, "")))
    shape = per({
        "email": yes_no(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")), "ip": yes_no(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "card": yes_no(value.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")), "phone": yes_no(value.rlike(r"^\+[0-9]{1,3}[ .(-]")),
        "local_phone": yes_no(value.rlike(r"^(\([0-9]{3}\) |[0-9]{3}[.-])")), "secret": yes_no(value.rlike("[0-9].*[0-9]") & value.rlike("[A-Za-z].*[A-Za-z]")),
    }, F.lit(1))
    checksum = per({
        "ip": yes_no(base), "card": yes_no(F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)), "phone": yes_no(base), "iban": yes_no(mod97(value)),
        "national_id": yes_no(~value.rlike("^(000|666|9)|-00-|-0000$")), "local_phone": yes_no(n == 10), "secret": yes_no(variety >= 8),
    })
    gazetteer = per({
        "email": yes_no(fold(F.regexp_extract(value, r"\.([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)), "ip": yes_no(~value.rlike(r"^(0|2[3-9][0-9])\b")), "card": yes_no(value.rlike("^[3456]")),
        "phone": yes_no(digits(value).rlike(CALLING)), "iban": yes_no(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IBANS.items() for x in kv]), F.substring(value, 1, 2)) == F.length(value), F.lit(False))),
        "secret": yes(value.rlike("^(AKIA|gh[pousr]_|xox|sk-|eyJ)")),
    })
    near = fold(F.concat(before, F.lit(" "), after))
    context = F.when(near.rlike(AGAINST), -1).otherwise(yes(per({k: near.rlike(cue) for k, cue in CUES.items()}, F.lit(False))))
    border = F.when(before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]"), -1).when(before.rlike(r"(^|\s)$") & after.rlike(r"^(\s|[.,;!?)]|$)"), 1).otherwise(0)
    return F.array(shape, checksum, gazetteer, context, border)


def _side(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike(r"^\s$"), "blank").when(c.rlike("^[A-Za-z0-9]$"), "word").when(c.rlike("^[.,;:!?]$"), "stop").otherwise("other")


def _features(value: Column, before: Column, after: Column, votes: Column) -> Column:
    """Values of the features of a span, each one of a few."""
    n = F.length(value)
    share = F.floor(4 * F.length(digits(value)) / F.greatest(n, F.lit(1))).cast("string")
    case = F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), "mixed").when(value.rlike("[a-z]"), "lower").when(value.rlike("[A-Z]"), "upper").otherwise("none")
    return F.array(F.least(F.floor(n / 4), F.lit(10)).cast("string"), share, case, _side(F.right(before, F.lit(1))), _side(F.left(after, F.lit(1))), *(votes[i].cast("string") for i in (1, 2, 3)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, spans array<struct<kind, start, end, value, before, after, base, may>>) for every row of docs.

    Whole texts are read once. base: a match that holds what its kind asks for. may: no base span, but may be added;
    the other matches, such as numbers that fail their checksum, only speak for what no personal data looks like.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    might = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "more": F.col("text").rlike(MIGHT)}
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    more = "|".join(f"(?<![A-Za-z0-9+]){p}" for p in MORE.values())

    def tagged(kind: str) -> Column:
        def tag(s: Column) -> Column:
            base, n = holds(kind, s["value"]), F.length(digits(s["value"]))
            may = F.when(n.between(13, 15), luhn(digits(s["value"]))).otherwise(False) if kind == "card" else F.lit(False)
            return F.struct(F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("start", "end", "value", "before", "after")), base.alias("base"), (~base & may).alias("may"))

        spans = found(F.col("text"), BASE[kind])
        if kind == "card":
            spans = F.filter(spans, lambda s: F.length(digits(s["value"])).between(13, 19))
        return F.transform(F.when(might[kind], spans).otherwise(none) if kind in might else spans, tag)

    def other(s: Column) -> Column:
        kind = reduce(lambda out, k: F.when(s["value"].rlike(f"^{MORE[k]}$"), k).otherwise(out), reversed(MORE), F.lit("secret"))
        name = F.regexp_extract(s["value"], NAMED, 0)
        value, before = F.substring(s["value"], F.length(name) + 1, F.length(s["value"])), F.substring(F.concat(s["before"], name), -NEAR, NEAR)
        return F.struct(kind.alias("kind"), (s["start"] + F.length(name)).alias("start"), s["end"].alias("end"), value.alias("value"), before.alias("before"), s["after"].alias("after"), F.lit(False).alias("base"), F.lit(True).alias("may"))

    others = F.transform(F.when(might["more"], found(F.col("text"), more)).otherwise(none), other)
    return read.select("row", "doc_id", F.concat(*(tagged(kind) for kind in BASE), others).alias("spans"))


def clear(spans: DataFrame) -> DataFrame:
    """spans(row, start, end, base, ...) without those that aren't base but that a base span of their row overlaps."""
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return spans.withColumn("met", met).filter("base OR NOT met").drop("met")


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, likely): from patterns(kind, votes, n), the probability that a span with these votes is personal data.

    One row for each kind with all of its patterns (at most 3 to the number of labelers), folded over the rounds. The
    prior and each labeler's chance of voting -1, 0 or 1 on personal and other spans are re-estimated in each; labelers
    start out as right in three votes of four.
    """
    m = len(LABELERS)
    own = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("p"))
    first = F.struct(F.lit(0.0).alias("prior"), F.array(*[F.array(*[F.lit(x) for x in (-1.1, 0.0, 1.1)])] * m).alias("w"))

    def likely(state: Column, p: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), state["prior"], lambda a, j: a + state["w"][j][p["votes"][j] + 1])
        return 1 / (1 + F.exp(-total))

    def step(state: Column, _: Column) -> Column:
        def refit(r: Column) -> Column:
            soft = lambda keep, personal: F.aggregate(F.zip_with(F.col("p"), r, lambda p, x: F.when(keep(p), p["n"] * (x if personal else 1 - x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
            yes, no = (soft(lambda p: F.lit(True), personal) for personal in (True, False))

            def weights(j: Column) -> Column:
                return F.transform(F.array(*[F.lit(v) for v in (-1, 0, 1)]), lambda v: F.log((soft(lambda p: p["votes"][j] == v, True) + 0.5) / (yes + 1.5)) - F.log((soft(lambda p: p["votes"][j] == v, False) + 0.5) / (no + 1.5)))

            return F.struct(F.log((yes + 1) / (no + 1)).alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(m - 1)), weights).alias("w"))

        return _let(F.transform("p", lambda p: likely(state, p)), refit)

    fitted = own.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step))
    return fitted.select("kind", F.explode(F.transform("p", lambda p: F.struct(p["votes"].alias("votes"), likely(F.col("state"), p).alias("likely")))).alias("x")).select("kind", "x.*")


def classify(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """spans(row, kind, start, end, base, may, votes, features) that aren't base, with score, the log-odds of being personal data."""
    patterns = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    soft = spans.join(F.broadcast(reliabilities(patterns, rounds)), ["kind", "votes"])
    each = soft.select("kind", "likely", F.posexplode("features").alias("feature", "value"))
    sums = each.groupBy("kind", "feature", "value").agg(F.sum("likely").alias("yes"), F.sum(1 - F.col("likely")).alias("no"))
    whole = sums.groupBy("kind", "feature").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    weight = sums.join(whole, ["kind", "feature"]).select("kind", "feature", "value", (F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 5)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 5))).alias("weight"))
    prior = whole.filter("feature = 0").select("kind", F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"))
    place = ("row", "kind", "start", "end")
    scored = spans.filter("may").select(*place, F.posexplode("features").alias("feature", "value")).join(F.broadcast(weight), ["kind", "feature", "value"])
    scored = scored.groupBy(*place).agg(F.sum("weight").alias("weight"))
    return scored.join(F.broadcast(prior), "kind").select(*place, (F.col("weight") + F.col("prior")).alias("score"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base array<struct<kind, start, end>>, added array<struct<kind, start, end, score>> for every row of docs.

    Base spans are those of the patterns that hold what their kind asks for; they always stay. Added spans are further
    candidates that the trained classifier finds likelier personal data than not and that no base span overlaps; cards
    of 13 to 15 digits are candidates if they pass the checksum. Positions are code points, ends exclusive. Null and
    empty texts have none. Repeated rows each have their spans; an empty table gives no rows; further columns are not
    read. The time follows the texts' lengths and numbers of matches, also where a text holds thousands of them.
    """
    held = stored(candidates(docs, id_col, text_col), "pii-candidates")
    spans = clear(held.select("row", F.explode("spans").alias("s")).select("row", "s.*"))
    votes = spans.withColumn("votes", _votes(F.col("kind"), F.col("value"), F.col("before"), F.col("after"), F.col("base")))
    spans = stored(votes.select("row", "kind", "start", "end", "base", "may", "votes", _features(F.col("value"), F.col("before"), F.col("after"), F.col("votes")).alias("features")), "pii-votes")
    added = classify(spans, rounds).filter("score > 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "score"))).alias("added"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = held.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.expr("cast(array() AS array<struct<kind: string, start: int, end: int, score: double>>)")).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end, by kind as in KINDS, then start), n_spans (of all)."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(F.transform(F.concat("base", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.struct(order[s["kind"]].alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    both = (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return found.select("doc_id", *(number(k) for k in BASE), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text(ranked).alias("spans"), both)
