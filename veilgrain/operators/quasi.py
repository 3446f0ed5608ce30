"""Quasi-identifiers: attributes of a person, their weights, and coarsening until the score is below k."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.functions import institutions
from veilgrain.operators.spans import matches, resolved

# Category weights, coarsening order, limits by level.
WEIGHTS = {"place": 2, "org": 2, "cohort": 2, "rare": 2, "role": 1, "age": 1, "family": 1}
ORDER = ("place", "org", "cohort", "rare", "age", "role", "family")
K = {"balanced": 3, "strict": 2}
# Wordings by rule, with the phrase that replaces them (None: counted and kept; %d: decade).
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
ATTRIBUTES = (
    ("en_class_of", "cohort", r"\bclass of ((?:19|20)\d{2})\b", "a class of the %ds"),
    ("en_joined", "cohort", rf"\b(?:joined|hired|started|enrolled|graduated|retired|promoted)[ \t]+(?:in[ \t]+)?(?:{MONTH}[ \t]+)?((?:19|20)\d{{2}})\b", "in the %ds"),
    ("en_champion", "cohort", r"\b((?:19|20)\d{2})[ \t]+(?:state|national|regional|world|conference|league|district)[ \t]+champion(?:ship)?s?\b", "a champion"),
    ("ko_cohort", "cohort", r"(?<!\d)((?:19|20)\d{2})\s*년(?:도)?\s*(?:(?:상반기|하반기|신입|경력)\s*)?(?:공채|공개채용|입사|입학|졸업|임용|수능|전역|제대|합격|임관|수료)", "%d년대"),
    ("en_medal", "rare", r"\b(?:gold|silver|bronze)[ \t]+medal(?:ist)?\b|\brecord[- ]holder\b|\bvaledictorian\b", "a prize winner"),
    ("en_speaking", "rare", r"\b[A-Z][a-z]+-speaking\b", None),
    ("en_unique", "rare", r"\b(?:the|my|our|his|her)[ \t]+only\b|\bsole\b", None),
    ("en_twin", "rare", r"\b(?:a twin|twins|triplets)\b", None),
    ("en_hand", "rare", r"\bleft-handed\b", None),
    ("ko_unique", "rare", r"유일한|유일하게|하나뿐인|혼자만", None),
    ("ko_twin", "rare", r"쌍둥이|세쌍둥이", None),
    ("en_old", "age", r"\b(\d{2})-year-old\b", "%d-something"),
    ("en_i_am", "age", r"(?<=\bI'm[ \t]|\bIm[ \t]|\bI am[ \t])(\d{2})\b(?![ \t]*(?:%|percent|years? (?:of|in)|kg|lbs|minutes|hours|days|weeks|months|miles|km))", "in my %ds"),
    ("en_born", "age", r"\bborn in ((?:19|20)\d{2})\b", "born in the %ds"),
    ("ko_age", "age", r"(?<![\d가-힣])(?:만\s?)?(\d{1,2})\s?(?:세|살)(?![가-힣])", "%d대"),
    ("family", "family", r"다둥이|삼남매|사남매|오남매|외동(?:딸|아들)?|한부모|싱글맘|싱글대디|미혼모|미혼부|입양아?|조손가정|\b(?:single (?:mom|mother|dad|father|parent)|only child|widow(?:ed|er)?|adoptive)\b", None),
    ("en_place", "place", r"\b[A-Z][a-z]+, [A-Z]{2}\b", "a town"),
    ("en_role", "role", r"\b(?:nurse|teacher|engineer|pharmacist|lawyer|officer|captain|professor|manager|developer|doctor|surgeon)\b", "a professional"),
)
PERSON = (
    r"(?i)\b(?:I|I'm|I've|I'd|me|my|we|our)\b|\b(?:dad|mom|father|mother|wife|husband|son|daughter|brother|sister|partner)\b"
    r"|anonymous|anonymously|without naming|can't be traced|cannot be traced|identify me"
    r"|(?:저는|저도|제가|저희|내가|나는|우리|본인)(?=\s|$)|엄마|어머니|아빠|아버지|남편|아내|아들|딸|익명|신원"
)


FOUND = "array<struct<start:int,end:int,text:string,category:string,rule:string,phrase:string,source:string,action:string>>"


def _java(pattern: str) -> str:
    return f"(?U){pattern}"


def _attribute(category: str, rule: str, phrase: str | None) -> Callable[[Column], Column]:
    """A match as an attribute, with the phrase that replaces it: its own decade in the place of %d."""

    def made(s: Column) -> Column:
        said = F.lit(phrase).cast("string")
        if phrase is not None and "%d" in phrase:
            decade = (F.floor(F.regexp_extract(s["text"], r"(\d{2,4}|\d)", 1).try_cast("int") / 10) * 10).cast("int").cast("string")
            head, tail = phrase.split("%d")
            said = F.concat(F.lit(head), decade, F.lit(tail))
        place = (s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))
        return F.struct(*place, F.lit(category).alias("category"), F.lit(rule).alias("rule"), said.alias("phrase"), F.lit("rule").alias("source"), F.lit("generalize").alias("action"))

    return made


def attributes(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, start, end, text, category, rule, phrase): attributes in a text, longest first and without overlap.  All
    rules look at a text in one scan, inside the JVM, and what they find is chosen from in its row."""
    t, found, none = F.col(text), [], F.array().cast(FOUND)
    for rule, category, pattern, phrase in ATTRIBUTES:
        plain = _java(re.sub(r"(?<!\\)\((?=\(\?:19|\\d\{)", "(?:", pattern))  # no capturing groups
        own = F.transform(matches(t, plain), _attribute(category, rule, phrase))
        found.append(F.coalesce(F.when(F.rlike(t, F.lit(plain)), own), none))  # the matches are only worked out where there are some
    out = df.select(*keys, F.explode(resolved(F.flatten(F.array(*found)))).alias("a"))
    return out.select(*keys, "a.start", "a.end", "a.text", "a.category", "a.rule", "a.phrase")


def weight(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[category]


def scores(attrs: DataFrame, *keys: str) -> DataFrame:
    """(keys, score): the sum over categories of the greatest weight."""
    per = attrs.groupBy(*keys, "category").agg(F.max(weight(F.col("category"))).alias("w"))
    return per.groupBy(*keys).agg(F.sum("w").cast("long").alias("score"))


def coarsened(attrs: DataFrame, level: str, *keys: str) -> DataFrame:
    """The attributes to coarsen, heaviest first, until the score is below the level's k.

    Removing an attribute lowers the score only with the last one of its category, so an attribute is
    chosen as long as the score of those not yet chosen before it is at least k."""
    k = K.get(level)
    if k is None:
        return attrs.where(F.lit(False))
    grouped = attrs.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "text", "category", "rule", "phrase")).alias("all"))

    def total(items: Column) -> Column:
        present = F.array_distinct(F.transform(items, lambda a: a["category"]))
        return F.aggregate(F.transform(present, weight), F.lit(0), lambda s, w: s + w)

    place = lambda a: F.array_position(F.array(*map(F.lit, ORDER)), a["category"])
    ranked = F.array_sort(F.transform(F.filter("all", lambda a: a["phrase"].isNotNull()), lambda a: F.struct((-weight(a["category"])).alias("w"), place(a).alias("p"), a["start"].alias("s"), a.alias("a"))))
    step = F.struct(F.col("all").alias("left"), F.slice("all", 1, 0).alias("out"))
    walked = F.aggregate(
        ranked,
        step,
        lambda acc, x: F.when(total(acc["left"]) < k, acc).otherwise(F.struct(F.filter(acc["left"], lambda a: a["start"] != x["s"]).alias("left"), F.concat(acc["out"], F.array(x["a"])).alias("out"))),
        lambda acc: acc["out"],
    )
    return grouped.select(*keys, F.explode(walked).alias("a")).select(*keys, "a.*")


def about_a_person(text: Column) -> Column:
    return F.rlike(text, F.lit(_java(PERSON)))


def case_k(k: Column, situation: Column) -> Column:
    """Identity attributes needed to identify: at least two."""
    return F.greatest(F.lit(2), k - situation)


def max_found(found: DataFrame, *keys: str) -> DataFrame:
    """Most attributes of a case found at one destination."""
    per = found.groupBy(*keys, "destination").agg(F.count_distinct("attribute").alias("n"))
    return per.groupBy(*keys).agg(F.max("n").alias("max_found"))


def value_kind(value: Column) -> Column:
    """email, phone, address, number or name; the first that fits."""
    plain = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    digits = F.length(F.regexp_replace(plain, "[^0-9]", ""))
    return (
        F.when(F.rlike(value, F.lit(r"[\w.+-]+@[\w-]+\.[\w.]+")), "email")
        .when(F.rlike(F.trim(value), F.lit(r"^(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3,4}-\d{4})$")), "phone")
        .when(F.rlike(value, F.lit(r"\d+동 \d+호|\b\d+ [A-Z][a-z]+(?: [A-Z][a-z]+)* (?:Street|Road|Lane|Drive|Court|Avenue)\b")), "address")
        .when((F.length(plain) > 0) & (digits >= 0.6 * F.length(plain)), "number")
        .otherwise("name_org_or_code")
    )


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


# Words that say nothing of one person, and endings of Korean words.
COMMON = "학교 중학교 고등학교 초등학교 아파트 교회 부대 지역 마을 도시 공무원 의사 교사 선수 대회 school high church town city county state team company university teacher doctor".split()
WORD_END = "(?:이었고|이었어|이었는데|였고|였어|였는데|이고|인데|이야|이며|입니다|이에요|예요|에서|에게|으로|이|가|은|는|을|를|의|과|와|도|로|에|고|야)$"


def content_words(text: Column) -> Column:
    """Distinct words that a text is about: Korean ones of two syllables without their ending, Latin ones of four letters."""
    korean = F.transform(F.regexp_extract_all(text, F.lit("[가-힣]{2,}"), F.lit(0)), lambda w: F.regexp_replace(w, WORD_END, ""))
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z\-]{3,}"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(F.concat(korean, latin), lambda w: (F.length(w) >= 2) & ~w.isin(*COMMON)))


def relevant(df: DataFrame, text: str, attrs: DataFrame, *keys: str) -> DataFrame:
    """`attrs` (keys, start, end, ...) with `relevant`: a content word of the attribute also stands in the text (keys,
    text) outside all its attributes, so the question needs it."""
    others = [c for c in attrs.columns if c not in keys]
    held = attrs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.struct(*others).alias("own")))).alias("_attrs"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.col(text)
    outside = F.aggregate("_attrs", start, lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(" ")).alias("out")), lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    rest = df.join(held, list(keys)).select(*keys, t.alias("_t"), "_attrs", outside.alias("_outside")).select(*keys, "_t", "_attrs", content_words(F.col("_outside")).alias("_rest"))
    each = rest.select(*keys, "_t", "_rest", F.explode("_attrs").alias("_a"))
    own = content_words(F.expr("substring(_t, _a.start + 1, _a.end - _a.start)"))
    return each.select(*keys, "_a.own.*", F.arrays_overlap(own, "_rest").alias("relevant"))


def institution_attributes(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, start, end, text, category, rule, phrase): named institutions, school classes and small groups as
    attributes of the category org, longest first and without overlap."""
    kinds, n = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                kept: list[institutions.Institution] = []
                for f in sorted(institutions.institutions(t or ""), key=lambda f: (f.start - f.end, f.start)):
                    if all(f.end <= k.start or k.end <= f.start for k in kept):
                        kept.append(f)
                at += [i] * len(kept)
                rows += [(f.start, f.end, t[f.start : f.end], "org", f.rule, f.phrase) for f in sorted(kept)]
            own = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            made = [pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [*keys, "start", "end", "text", "category", "rule", "phrase"])

    return df.select(*keys, text).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start int, end int, text string, category string, rule string, phrase string"]))
