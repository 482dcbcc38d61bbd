"""Personal data spans by weak supervision, in DataFrame expressions only.

Base kinds are exact patterns and always kept: email, ip, card (14 to 19 digits
with a valid check digit) and phone (10 to 15 digits). The method adds spans of
further kinds from broad candidates: ``secret`` (long mixed tokens),
``account`` (card-like numbers without a valid check digit), ``local_phone``
and ``person`` (title and name).

Labelers vote +1, -1 or 0 on each candidate: a strict regular expression, a
gazetteer of words before the candidate (for and against), the punctuation
before it, the mix of its characters, and base spans close by. The votes'
patterns are counted (a few hundred rows whatever the corpus), and expectation
maximisation on these counts gives each labeler's reliability for each kind and
each pattern's probability. These soft labels train the final classifier: a
naive Bayes model over the candidate's length, character classes, the word
before it (hashed) and its neighbouring characters; its counts are one grouped
sum. A candidate is kept if the classifier gives it at least one half.

Positions: a text is split at the matches; a match starts where the parts and
matches before it end, a running sum made in blocks of about the square root of
their number. Loops over groups are avoided: separators inside a match are first
replaced, one code point for one, by a private-use character, so that every
pattern is a run over one character class and long texts cannot exhaust the
regular-expression stack or scan a run of characters twice. Candidates are
searched in a copy of the text with the base spans blotted out, so none overlaps
one. Contexts and the pieces between spans are read from pages of ``PAGE`` code
points, so no step walks from the start of a text to each of its matches: the
time grows with the text and with its matches, not with their product.

Defined results: a null text is empty and has no spans; offsets are code
points, ends exclusive; spans that start together are ordered by kind as listed;
repeated rows have the same spans; an empty table gives no rows; without
candidates nothing is added; other columns, whatever their names, pass through
``redacted`` and are ignored by the query; very long texts are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import before, let, materialize, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "local_phone", "person")
KINDS = (*BASE, *ADDED)
MARK, OTHER, BLOT = "\ue000", "\ue001", "\ue002"
WORD_BUCKETS = 64
PAGE = 1024

# Words before personal data, and before what only looks like it (English, German, French, Spanish).
FOR_WORDS = (
    "token key secret password passwd pwd credential apikey bearer auth account acct iban card number no nr phone tel telephone mobile cell call fax "
    "contact name owner patient customer mr mrs ms dr prof ssn id user login "
    "passwort kennwort schlüssel konto kontonummer karte kartennummer nummer telefon telefonnummer handy kunde kundin inhaber benutzer "
    "passe clé compte carte numéro téléphone portable titulaire client cliente utilisateur "
    "contraseña clave cuenta tarjeta número teléfono móvil titular usuario"
).split()
AGAINST_WORDS = (
    "version license licence page pages isbn issn figure table section chapter build revision commit sha md5 checksum hash doi "
    "lizenz seite seiten abbildung tabelle abschnitt kapitel ausgabe prüfsumme "
    "licence tableau chapitre édition révision licencia página páginas figura tabla sección capítulo edición revisión"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Don Doña Sr Sra".split()

LOCAL = "A-Za-z0-9._%+\\-" + MARK
EMAIL = f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9\\-{MARK}]*+"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"[0-9][0-9{MARK}]++"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
SECRET = "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"
LOCAL_PHONE = "\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}"
PERSON = f"(?<!\\p{{L}})(?:{'|'.join(TITLES)})\\.? \\p{{Lu}}\\p{{Ll}}{{1,30}}+(?: \\p{{Lu}}\\p{{Ll}}{{1,30}}+)?"

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _positions(text: Column, pattern: str, maybe: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, text>>; none where ``maybe`` is false."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def placed(v: Column) -> Column:
        ends = before(F.transform(v, lambda z: F.length(z["m"]) + z["g"]), lambda a, x: a + x)
        return F.zip_with(
            v, ends, lambda z, at: F.struct((at + z["g"]).alias("start"), (at + z["g"] + F.length(z["m"])).alias("end"), z["m"].alias("text"))
        )

    # one gap more than matches follows the last of them
    found = let(F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda z: z["m"].isNotNull()), placed)
    return F.when(maybe, found).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def _pages(text: Column) -> Column:
    """The text in pieces of ``PAGE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def _part(pages: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (exclusive), read from its pages."""
    a, b = F.floor(start / PAGE).cast("int"), F.floor(end / PAGE).cast("int")
    head, tail = F.coalesce(F.get(pages, a), F.lit("")), F.coalesce(F.get(pages, b), F.lit(""))
    within = F.substring(head, start % PAGE + 1, end - start)
    over = F.concat(F.substring(head, start % PAGE + 1, F.lit(PAGE)), F.concat_ws("", F.slice(pages, a + 2, F.greatest(b - a - 1, F.lit(0)))), F.substring(tail, F.lit(1), end % PAGE))
    return F.when(end <= start, "").when(a == b, within).otherwise(over)


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each of the sorted ``spans`` replaced by ``by(span, end of those before it)``."""

    def whole(v: Column) -> Column:
        held = before(F.transform(v["spans"], lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        pieces = F.zip_with(v["spans"], held, lambda s, at: F.concat(_part(v["pages"], at, s["start"]), by(s, at)))
        last = F.array_max(F.transform(v["spans"], lambda s: s["end"]))
        return F.concat(F.concat_ws("", pieces), _part(v["pages"], last, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.struct(_pages(text).alias("pages"), spans.alias("spans")), whole)).otherwise(text)


def _of_kind(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["text"].alias("text")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.translate(text, MARK, OTHER), pattern, MARK)


def find_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``keep``, all by default), base spans, candidates with their context."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.struct(*(keep or docs.columns)).alias("row"), t.alias("text"))
    text = F.col("text")
    has_card = text.rlike("[0-9](?:[ -]?[0-9]){13}")
    cards = _positions(_marked(text, "(?<=[0-9])[ -](?=[0-9])"), CARD, has_card)
    d = d.select(
        "row",
        "text",
        _positions(_marked(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])"), EMAIL, text.contains("@")).alias("emails"),
        _positions(text, IP, text.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]")).alias("ips"),
        F.filter(cards, lambda x: F.length(_digits(x["text"])).between(14, 19)).alias("cards"),
        _positions(text, PHONE, text.contains("+")).alias("phones"),
    )

    def part_ok(p: Column) -> Column:
        short = F.regexp_replace(p, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short) <= 3, short).try_cast("int"), F.lit(0)) <= 255)

    kept = [
        F.col("emails"),
        F.filter("ips", lambda x: F.forall(F.split(x["text"], "\\."), part_ok)),
        F.filter("cards", lambda x: _luhn(_digits(x["text"]))),
        F.filter("phones", lambda x: F.length(_digits(x["text"])).between(10, 15)),
    ]
    base = F.array_sort(
        F.concat(*[F.transform(_of_kind(c, k), lambda x: F.struct(x["start"], x["kind"], x["end"])) for k, c in enumerate(kept)])
    )
    d = d.withColumn("base", base)
    blotted = _replaced(
        F.translate(text, BLOT, OTHER), F.col("base"), lambda s, at: F.repeat(F.lit(BLOT), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
    )
    d = d.withColumn("text", blotted)
    wide = [
        F.filter(_positions(text, SECRET, text.rlike("[A-Za-z0-9_-]{24}")), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]")),
        F.filter(
            _positions(_marked(text, "(?<=[0-9])[ -](?=[0-9])"), CARD, text.rlike("[0-9](?:[ -]?[0-9]){13}")),
            lambda x: let(_digits(x["text"]), lambda n: F.length(n).between(14, 19) & ~_luhn(n)),
        ),
        _positions(text, LOCAL_PHONE, text.rlike("\\([0-9]{3}\\)")),
        _positions(text, PERSON, text.rlike(f"(?:{'|'.join(TITLES)})\\.? \\p{{Lu}}")),
    ]
    d = d.withColumn("free", F.concat(*[_of_kind(c, len(BASE) + k) for k, c in enumerate(wide)]))

    def described(x: Column, pages: Column) -> Column:
        left = F.lower(_part(pages, F.greatest(x["start"] - 80, F.lit(0)), x["start"]))
        right = _part(pages, x["end"], x["end"] + 80)
        return let(
            F.struct(F.right(left, F.lit(40)).alias("near"), left.alias("left"), right.alias("right")),
            lambda c: F.struct(
                x["start"].alias("start"),
                x["kind"].alias("kind"),
                x["end"].alias("end"),
                x["text"].alias("text"),
                F.regexp_extract(c["near"], "([\\p{L}]{1,30})[^\\p{L}]{0,12}$", 1).alias("word"),
                F.regexp_extract(c["near"], "([^\\p{L}\\p{N}]{1,4})$", 1).alias("before"),
                F.substring(c["right"], 1, 1).alias("after"),
                (c["left"].contains(BLOT) | c["right"].contains(BLOT)).alias("near"),
            ),
        )

    candidates = let(_pages(text), lambda pages: F.transform("free", lambda x: described(x, pages)))
    none = F.transform(F.slice("free", 1, 0), lambda x: described(x, F.array().cast("array<string>")))
    return d.select("row", "base", F.when(F.size("free") > 0, candidates).otherwise(none).alias("candidates"))


def votes(c: Column) -> list[Column]:
    """The labelers' votes on a candidate."""
    text, kind = c["text"], c["kind"]
    secret, account, local_phone = (kind == len(BASE) + i for i in range(3))
    strict = (
        F.when(secret, text.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$|^(?:ghp_|sk-|AKIA)"))
        .when(account, F.length(_digits(text)).isin(15, 16))
        .when(local_phone, text.rlike("^\\([2-9][0-9]{2}\\) "))
        .otherwise(text.rlike(" [A-Z][a-z]+ [A-Z]"))
    )
    distinct = F.size(F.array_distinct(F.split(F.lower(text), "")))
    share = F.length(_digits(text)) / F.length(text)
    mixed = F.when(secret, (share > 0.15) & (share < 0.9) & (distinct >= 10)).when(account, distinct >= 5).when(local_phone, distinct >= 6).otherwise(distinct >= 5)

    def vote(yes: Column, no: Column | None = None) -> Column:
        v = F.when(yes, F.lit(1))
        return (v if no is None else v.when(no, F.lit(-1))).otherwise(F.lit(0))

    return [
        vote(strict, ~strict),
        vote(c["word"].isin(FOR_WORDS), c["word"].isin(AGAINST_WORDS)),
        vote(c["before"].rlike("[=:]\\s*[\"']?$|[\"']$"), c["before"].rlike("[/._]$")),
        vote(mixed, ~mixed),
        vote(c["near"]),
    ]


def fit_reliabilities(counts: dict[tuple[int, tuple[int, ...]], float], rounds: int = 60) -> dict[tuple[int, tuple[int, ...]], float]:
    """Probability of each (kind, vote pattern), by expectation maximisation for each kind alone.

    Starts from the share of positive votes; a labeler's chances of each vote
    given true or false are re-estimated with a small prior towards being right.
    """
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _ in counts}):
        mine = {p: n for (k, p), n in counts.items() if k == kind}
        size = len(next(iter(mine)))
        belief = {p: (1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p in mine}
        for _ in range(rounds):
            total = [2.0, 2.0]
            chance = [[{1: 0.6, 0: 1.0, -1: 0.4}, {1: 0.4, 0: 1.0, -1: 0.6}] for _ in range(size)]
            for p, n in mine.items():
                for side, w in ((0, belief[p] * n), (1, (1 - belief[p]) * n)):
                    total[side] += w
                    for i, v in enumerate(p):
                        chance[i][side][v] += w
            for c in chance:
                for side in (0, 1):
                    s = sum(c[side].values())
                    c[side] = {v: x / s for v, x in c[side].items()}
            prior = math.log(total[0] / total[1])
            new = {}
            for p in mine:
                z = prior + sum(math.log(c[0][v] / c[1][v]) for c, v in zip(chance, p))
                new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            moved = max(abs(new[p] - belief[p]) for p in mine)
            belief = new
            if moved < 1e-9:
                break
        out.update({(kind, p): b for p, b in belief.items()})
    return out


def features(c: Column) -> Column:
    """Named features of a candidate, as array<string>; each from a bounded set."""
    kind = c["kind"].cast("string")
    text = c["text"]
    share = F.floor(4 * F.length(_digits(text)) / F.length(text)).cast("string")
    named = {
        "length": F.least(F.floor(F.length(text) / 4), F.lit(20)).cast("string"),
        "share": share,
        "shape": F.concat(text.rlike("[A-Z]").cast("string"), text.rlike("[g-zG-Z]").cast("string"), text.rlike("[_-]").cast("string")),
        "word": F.pmod(F.xxhash64(c["word"]), F.lit(WORD_BUCKETS)).cast("string"),
        "before": F.when(c["before"] == "", "none").when(c["before"].rlike("[\"'=:]"), "sign").when(c["before"].rlike("\\s$"), "blank").otherwise("other"),
        "after": F.when(c["after"] == "", "none").when(c["after"].rlike("\\s"), "blank").when(c["after"].rlike("[\"']"), "quote").otherwise("other"),
    }
    return F.array(*[F.concat(kind, F.lit(f":{name}:"), value) for name, value in named.items()])


def classify(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """``spans`` (a written table) with ``added``: the candidates that the trained classifier keeps."""
    none = F.array().cast(_SPANS)
    flat = spans.select(F.explode("candidates").alias("c"))
    flat = flat.select(F.col("c.kind").alias("kind"), F.array(*votes(F.col("c"))).alias("votes"), features(F.col("c")).alias("features"))
    counts = {(r["kind"], tuple(r["votes"])): float(r["n"]) for r in flat.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}  # at most kinds * 3 ** labelers rows
    if not counts:
        return spans.withColumn("added", none)
    belief = fit_reliabilities(counts)
    beliefs = F.create_map(*[x for (k, p), b in sorted(belief.items()) for x in (F.lit(f"{k}:{','.join(map(str, p))}"), F.lit(b))])
    p = beliefs[F.concat(F.col("kind").cast("string"), F.lit(":"), F.array_join(F.transform("votes", lambda v: v.cast("string")), ","))]
    sums = (
        flat.withColumn("p", p).select("kind", "p", F.explode(F.concat("features", F.array(F.concat(F.col("kind").cast("string"), F.lit(":all"))))).alias("f"))
        .groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    ).collect()  # a bounded set of feature values
    whole = {r["f"].split(":")[0]: (r["yes"] + 1, r["no"] + 1) for r in sums if r["f"].endswith(":all")}
    weight = {}
    for r in sums:
        yes, no = whole[r["f"].split(":")[0]]
        if r["f"].endswith(":all"):
            weight[r["f"]] = math.log(yes / no)
        else:
            weight[r["f"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    weights = F.create_map(*[x for f, w in sorted(weight.items()) for x in (F.lit(f), F.lit(w))])

    def keep(c: Column) -> Column:
        z = F.aggregate(features(c), F.coalesce(weights[F.concat(c["kind"].cast("string"), F.lit(":all"))], F.lit(0.0)), lambda a, f: a + F.coalesce(weights[f], F.lit(0.0)))
        return z >= 0

    kept = F.transform(F.filter("candidates", keep), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return spans.withColumn("added", F.when(F.size("candidates") > 0, kept).otherwise(none))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row, base, added: the spans of every row of ``docs``, found in one pass over the texts."""
    return classify(spark, materialize(spark, find_spans(docs, keep), "spans")).select("row", "base", "added")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span, overlapping ones joined, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return _replaced(text, F.array_sort(spans), lambda s, at: F.when(s["start"] >= at, F.get(names, s["kind"])).otherwise(""))


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; null texts stay null."""
    found = detect(spark, docs)
    clean = F.when(F.size("base") + F.size("added") > 0, redact(F.col("row.text"), F.concat("base", "added"))).otherwise(F.col("row.text"))
    return found.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(spark, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), ["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind]}")

    return found.select(
        "row.doc_id",
        *map(count, range(len(BASE))),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
