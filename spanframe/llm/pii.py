"""Personal data spans by weak supervision, in DataFrame operations only.

Candidates: what four fixed patterns match (base matches, if they pass their kind's test), and
what looser patterns match outside of base matches (written-out addresses, defanged addresses,
card numbers with other separators, national and 00 telephone numbers). Five labelers vote
+1, 0 (abstaining) or -1 on each candidate: checksum or number plan, gazetteer, context words,
bounds, shape. Expectation-maximisation over the counts of vote patterns, starting from the
majority, estimates how often each labeler is right about true and about false candidates; an
abstention says nothing. Its posteriors train a logistic classifier over the same votes, which
decides on the looser candidates. Base matches always stay.

The only thing gathered is the table of vote patterns with counts: 4 kinds x 3^5 rows at
most, whatever the corpus. Patterns are written so that the regex engine neither recurses nor
rescans on long runs; each base pattern equals its plain form in what it matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import let

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("checksum", "gazetteer", "context", "bounds", "shape")

#: The base patterns. (?:\G|(?<!..)) starts a match only where a run starts or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL, _HOST, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+", "[A-Za-z0-9-]{1,63}+", "[A-Za-z0-9-]{2,63}+"
_DOT = r"(?: ?(?:\(dot\)|\[dot\]) ?| dot )"
#: Looser patterns; their matches need the classifier.
LOOSE = {
    "email": rf"{_LOCAL}(?: ?(?:\(at\)|\[at\]) ?{_HOST}(?:(?:{_DOT}|\.){_LABEL}){{1,4}}+|(?: at |@){_HOST}(?:{_DOT}{_LABEL}){{1,4}}+)",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: Gazetteers (top-level domains, telephone country codes).
DOMAINS = ("com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "pt", "br", "mx", "ar", "jp", "cn", "in", "us", "ca", "au", "ru", "pl", "se", "no", "dk", "fi", "ie", "be")
COUNTRIES = r"^\+(?:1|7|20|27|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
#: Words before a span that speak for or against each kind.
FOR = {"email": "mail|contact|write|kontakt|correo|courriel|schreib", "ip": "ip|addr|host|server|adresse|client|login", "card": "card|visa|pay|credit|karte|carte|tarjeta|master", "phone": "phone|tel|call|mobile|fax|anruf|appel|llam|contact"}
AGAINST = {"email": "example", "ip": "version|ver\\.|release|build|v\\.?\\s*$|section", "card": "order|invoice|isbn|serial|token|hash|id\\s*$", "phone": "order|invoice|isbn|page|version|ref"}

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s int, e int, m string>>, code points, end exclusive."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(ms):
        # The pieces between the matches give the places; at(k) is where match k starts.
        def fold(ps):
            start = F.struct(F.lit(0).alias("at"), none.alias("out"))

            def step(a, x):
                s = a["at"] + F.length(x["p"])
                e = s + F.length(x["m"])
                return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

            return F.aggregate(F.zip_with(ms, F.slice(ps, 1, F.size(ms)), lambda m, p: F.struct(m.alias("m"), p.alias("p"))), start, step, lambda a: a["out"])

        return F.when(F.size(ms) == 0, none).otherwise(let(F.split(text, pattern, -1), fold))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The test of its kind that a base match must pass."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def votes(kind: str, strict: bool, text: Column, x: Column, good: Column) -> list[Column]:
    """The votes of LABELERS on candidate x (s, e, m) of the text; good: a base match that passes its test."""
    m = x["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    before = F.lower(F.substring(text, F.greatest(x["s"] - 31, F.lit(1)), F.least(x["s"], F.lit(32))))
    near = F.substring(text, F.greatest(x["s"], F.lit(1)), F.lit(1)), F.substring(text, x["e"] + 1, F.lit(1))
    vote = lambda plus, minus: F.when(plus, 1).when(minus, -1).otherwise(0)
    sure = lambda plus: F.when(plus, 1).otherwise(-1)
    national = F.regexp_replace(digits, "^(?:00[0-9]{1,3}(?=[0-9]{10}$))", "")
    if kind == "email":
        top = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        checksum, gazetteer = sure(top.rlike("^[a-z]{2,}$")), vote(top.isin(*DOMAINS), ~top.rlike("^[a-z]{2,6}$"))
        shape = vote(m.rlike(r"[0-9_%+.-].*(?:@|\(at\)|\[at\])|\(|\["), m.rlike(r"^[A-Z]?[a-z]+ at "))
    elif kind == "ip":
        checksum = sure(good if strict else F.regexp_replace(m, r"[\[\]()]", "").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        gazetteer = vote(F.lit(False), m.rlike(r"^(?:0|127|255)\b") | m.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
        shape = vote(F.length(digits) >= 7, F.length(digits) <= 5)
    elif kind == "card":
        checksum = sure(good if strict else F.length(digits).between(13, 19) & luhn(digits))
        gazetteer = vote(digits.rlike("^[3-6]"), digits.rlike("^[0189]"))
        shape = vote(F.length(digits).isin(15, 16), ~F.length(digits).between(13, 19))
    else:
        checksum = sure(good if strict else national.rlike("^[2-9][0-8][0-9][2-9]"))
        gazetteer = vote(m.rlike(COUNTRIES) if strict else national.rlike("^(?:555|800|888|877|866|212|213|312|415|202|206|617|718|646)"), m.rlike(r"^\+0") | national.rlike("^(?:000|123|999)"))
        shape = vote(m.rlike(r"\([0-9]{3}\)|^00|^\+"), m.rlike(r"[0-9] [0-9]{3}\.|\.[0-9]{3} "))
    outside = F.when((x["s"] > 0) & near[0].rlike("[A-Za-z0-9#$/=]") | near[1].rlike("[A-Za-z0-9%/=]"), -1).otherwise(1)
    return [checksum, gazetteer, vote(before.rlike(FOR[kind]), before.rlike(AGAINST[kind])), outside, shape]


CANDIDATE = "array<struct<kind:int,s:int,e:int,base:boolean,loose:boolean,v:array<int>>>"


def _judged(kind: str, strict: bool, text: Column):
    """The step from a match to a candidate."""

    def made(x):
        def rated(good):
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (F.lit(strict) & good).alias("base"), F.lit(not strict).alias("loose"), F.array(*votes(kind, strict, text, x, good)).alias("v"))

        return let(passes(kind, x["m"]) if strict else F.lit(False), rated)

    return made


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes; base: a base match that passes its test. Looser ones overlap no base match."""
    digit, none = text.rlike("[0-9]"), F.array().cast(CANDIDATE)
    at = F.contains(text, F.lit("@"))
    may = {"email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    hidden = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    spelt = text.rlike(r"(?: at |@).{1,70}(?: dot |\(dot\)|\[dot\])")
    may_loose = {"email": hidden | spelt, "ip": digit & text.rlike(r"[0-9](?:\[\.\]|\(\.\))[0-9]"), "card": digit & text.rlike(r"[0-9]{4}[._/][0-9]{4}"), "phone": digit & text.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")}

    def found(patterns, strict, may):
        return F.concat(*[F.when(may[kind], F.transform(find_all(text, pattern), _judged(kind, strict, text)).cast(CANDIDATE)).otherwise(none) for kind, pattern in patterns.items()])

    def both(firm):
        apart = lambda x: ~F.exists(firm, lambda y: y["base"] & (y["s"] < x["e"]) & (x["s"] < y["e"]))
        loose = F.when(may_loose["email"] | may_loose["ip"] | may_loose["card"] | may_loose["phone"], found(LOOSE, False, may_loose)).otherwise(none)
        return F.concat(firm, F.filter(loose, apart))

    return F.when(digit | at | hidden | spelt, let(found(BASE, True, may), both)).otherwise(none)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[tuple[float, float]], float]:
    """EM over (votes, count): posteriors per pattern, per labeler (P(+1 | true, voting), P(+1 | false, voting)), and the share of true ones."""
    n_labelers = len(LABELERS)
    post = [_sigmoid(1.0 * sum(v)) for v, _ in counts]
    table, share = [(0.7, 0.3)] * n_labelers, 0.5
    for _ in range(rounds):
        table = []
        for j in range(n_labelers):
            sums = {(up, y): 0.0 for up in (True, False) for y in (True, False)}
            for p, (v, c) in zip(post, counts):
                if v[j]:
                    sums[v[j] > 0, True] += p * c
                    sums[v[j] > 0, False] += (1 - p) * c
            # Smoothing leans on the labeler being better than chance.
            table.append(tuple((sums[True, y] + (1.4 if y else 0.6)) / (sums[True, y] + sums[False, y] + 2) for y in (True, False)))
        all_ = sum(c for _, c in counts)
        share = (sum(p * c for p, (_, c) in zip(post, counts)) + 1) / (all_ + 2)

        def odds(v):
            z = math.log(share / (1 - share))
            for x, (t, f) in zip(v, table):  # noqa: B023
                z += math.log(t / f) if x > 0 else math.log((1 - t) / (1 - f)) if x < 0 else 0.0
            return z

        post = [_sigmoid(odds(v)) for v, _ in counts]
    return post, table, share


def train(counts: list[tuple[tuple[int, ...], int]], soft: list[float], steps: int = 300) -> list[float]:
    """Logistic regression on the votes with soft labels: bias, then a weight for each labeler."""
    w = [0.0] * (len(LABELERS) + 1)
    total = max(1, sum(c for _, c in counts))
    for _ in range(steps):
        grad = [0.02 * x for x in w]
        for (v, c), y in zip(counts, soft):
            err = (_sigmoid(w[0] + sum(a * b for a, b in zip(w[1:], v))) - y) * c / total
            grad[0] += err
            for j, x in enumerate(v):
                grad[j + 1] += err * x
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def fit(docs: DataFrame, text: str = "text") -> dict[int, list[float]]:
    """Classifier weights per kind, from the vote patterns of all candidates of all documents.

    Null and empty texts have no candidates; texts are searched whole; equal rows count each. An
    empty table, or a kind without candidates, gives weights of zero but for a bias that refuses.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    seen = docs.select(F.explode(candidates(t)).alias("__c")).groupBy("__c.kind", "__c.v").count().collect()
    out = {}
    for kind in range(len(KINDS)):
        counts = sorted((tuple(r.v), r["count"]) for r in seen if r.kind == kind)
        out[kind] = train(counts, estimate(counts)[0]) if counts else [-1.0] + [0.0] * len(LABELERS)
    return out


def spans(docs: DataFrame, weights: dict[int, list[float]], text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with pii: array<struct<kind int, s, e, base>> ordered by kind, then start.

    A looser candidate counts if the classifier gives it `least` or more. A null text counts as empty, so has none; texts are searched whole,
    however long; equal rows get equal spans; an empty table gives no rows; an input column
    named pii is replaced.
    """
    docs = docs.drop("pii")
    t = F.coalesce(F.col(text), F.lit(""))

    def chosen(cs):
        def score(x):
            by_kind = F.element_at(F.array(*[F.array(*[F.lit(float(a)) for a in weights[k]]) for k in range(len(KINDS))]), x["kind"] + 1)
            return let(by_kind, lambda w: F.aggregate(F.zip_with(F.slice(w, 2, len(LABELERS)), x["v"], lambda a, b: a * b), F.element_at(w, 1), lambda a, b: a + b))

        base = F.filter(cs, lambda x: x["base"])
        loose = F.filter(cs, lambda x: x["loose"] & (score(x) >= math.log(least / (1 - least))))
        return F.sort_array(F.transform(F.concat(base, loose), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))))

    none = F.array().cast("array<struct<kind:int,s:int,e:int,base:boolean>>")
    return docs.withColumn("pii", let(candidates(t), lambda cs: F.when(F.size(cs) == 0, none).otherwise(chosen(cs))))


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with pii) with each span, overlapping ones together, replaced by <KIND>; the text stays null if it was."""
    t = F.col(text)
    by_start = F.sort_array(F.transform("pii", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(a, x):
        fresh = x["s"] >= a["at"]
        # A span that begins within the last one only moves its end.
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, F.concat(a["out"], F.substring(t, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0))), F.element_at(names, x["kind"] + 1))).otherwise(a["out"]).alias("out"))

    cut = F.aggregate(by_start, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return docs.withColumn(text, F.when(F.size("pii") > 0, cut).otherwise(t)).drop("pii")
