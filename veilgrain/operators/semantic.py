"""Semantic rules: unique roles, health with a person, organizations, names with a title, birth dates,
declared terms' types.  Each is a pattern and conditions on its sentence, inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions import korean
from veilgrain.functions import normalize as norm
from veilgrain.functions.generalize import BIRTH_DATE, situation_value, small_group
from veilgrain.operators.spans import literal_spans, sentences
from veilgrain.operators.vault import KEY

# Wordings.
ROLE = "nurse|doctor|physician|surgeon|dentist|pharmacist|therapist|engineer|developer|programmer|designer|lawyer|attorney|partner|paralegal|accountant|teacher|professor|instructor|principal|student|employee|worker|staffer|manager|director|executive|VP|CEO|CTO|CFO|founder|owner|officer|pilot|firefighter|detective|soldier|veteran|chef|cook|translator|interpreter|pastor|priest|rabbi|imam|woman|man|female|male|immigrant|refugee|foreigner|resident|tenant|patient|survivor|witness|parent|mother|father|mom|dad|twin|intern|contractor|scientist|researcher|analyst|clerk|cashier|driver|farmer|member"
ONLY_ROLE = rf"(?:only|sole)\s+(?!(?:if|when|one|way|thing|things|option|time|reason|because|after|before|to|for|in|on|at|a|the|person|people|one's)\b)(?:[A-Za-z0-9'\-]+\s+){{0,4}}(?:{ROLE})s?(?![A-Za-z])"
UNIQUE = rf"(?<=[Tt]he |[Oo]ur |[Mm]y |[Hh]is |[Hh]er |[Tt]heir |[Ii]ts |'s ){ONLY_ROLE}"
EN_HEALTH = r"(?i)(?<![A-Za-z])(?:(?:type [12] )?diabetes|depression|major depressive disorder|(?:generalized )?anxiety disorder|panic (?:disorder|attacks)|bipolar(?: disorder)?|schizophrenia|OCD|PTSD|ADHD|autism|epilepsy|seizures|dementia|Alzheimer's|Parkinson's|heart attack|hypertension|(?:(?:breast|lung|colon|prostate|pancreatic|thyroid|skin|ovarian|cervical|stage [0-4I]{1,3}) )?cancer|leukemia|lymphoma|chemotherapy|chemo|radiation therapy|asthma|HIV|AIDS|hepatitis [ABC]|tuberculosis|pregnant|pregnancy|miscarriage|abortion|IVF|infertility|insulin|antidepressants?|eating disorder|anorexia|bulimia|insomnia|multiple sclerosis|Crohn's disease|lupus|self-harm|suicidal|overdose)(?![A-Za-z])"
EN_PERSON = r"(?<![A-Za-z])(?:I|I'm|I've|my|me|he|she|his|her|him|patient|employee|coworker|co-worker|colleague|son|daughter|wife|husband|mom|mother|dad|father|brother|sister|friend|boss|client|customer|tenant|student)(?![A-Za-z])"
EN_HEALTH_VERB = r"(?i)(?<![A-Za-z])(?:diagnos\w*|prescri\w*|taking|takes|suffer\w*|treated|treatment|battl\w*|recover\w*|hospitali\w*|admitted|relaps\w*|living with|tested positive|on medication|struggl\w*|went into rehab|in rehab)(?![A-Za-z])"
KO_HEALTH = r"(?<![가-힣A-Za-z])(?:(?:갑상선|유방|위|폐|대장|직장|간|췌장|전립선|자궁|난소|피부|혈액|방광)암|우울증|조울증|공황장애|불안장애|양극성장애|강박장애|조현병|섭식장애|불면증|뇌전증|치매|파킨슨병|뇌졸중|뇌경색|심근경색|협심증|부정맥|고혈압|당뇨병|당뇨|백혈병|림프종|천식|결핵|간염|임신|난임|불임|항암치료|항우울제|ADHD|PTSD|HIV|AIDS)(?![A-Za-z])"
KO_PERSON = r"(?<![가-힣])(?:저는|저도|제가|저의|저희|제|내가|나는|난|내|우리|본인)(?=\s|$)|엄마|어머니|아빠|아버지|남편|아내|아들|딸|친구|동료|팀원|직원|고객|[가-힣]\s?(?:님|씨)|진단(?:을\s?)?받|판정(?:을\s?)?받|처방|수술(?:을\s?)?받|앓|복용|치료\s?중|입원|퇴원|휴직|투병"
ORG_SUFFIX = r"(?:Inc\.?|LLC|L\.L\.C\.|Ltd\.?|Corp\.?|Corporation|Co\.|Company|Systems|Logistics|Analytics|Architects|Associates|Holdings|Partners|Labs|Laboratories|Technologies|Solutions|Industries|Freight|Pharmaceuticals|Pharma|Group|Bank|Credit Union|Capital|Ventures|Consulting|Hospital|Clinic|Health|Energy|Foods|Motors|Manufacturing|Studios|Media|Software|Robotics|Biotech|Insurance|Networks|Dynamics|Devices|Therapeutics|Outfitters|Brewing|Realty|Legal|LLP|Semiconductors?|Electronics|Retail|Dental|Pharmacy|Aerospace|Automotive|Chemicals|Textiles|Publishing|Airlines|Shipping|Construction|Engineering|Bakery|Brewery|University|College|Academy|Institute)"
ORG = rf"(?<![A-Za-z])(?:[A-Z][A-Za-z&'’\-]*[ \t]+){{1,3}}{ORG_SUFFIX}(?![A-Za-z])"
ORG_NOT_FIRST = tuple("The A An Our My Their Your This That In At For With From To Dear Hi Hello Thanks Information Operating Computer Human Customer Public Local National General Mental Global Management Private Community Regional State Federal Venture Health Energy Support Security Software".split())
KO_ORG = r"(?:주식회사\s?|㈜|\(주\))[가-힣A-Za-z0-9]{2,12}|[가-힣A-Za-z0-9]{2,10}(?:주식회사|㈜|저축은행|은행|병원|의원|대학교|재단|협회|공사|그룹|물류|전자)"
LABELED_NAME = r"(?:(?<=[Nn]ame: )|(?<=[Mm]y name is ))[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}"


def unique_roles(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return literal_spans(df, text, UNIQUE, *keys).withColumns({"type": F.lit("QUASI_IDENTIFIER"), "action": F.lit("generalize"), "rule": F.lit("en_quasi"), "replacement": F.lit("someone in a specific role")})


def health(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Health terms in sentences that are about a person: in Korean a person or a verb of care is enough, in
    English it takes both."""
    s = sentences(df, text, *keys)
    ko = s.where(F.rlike("sentence", F.lit(KO_PERSON)))
    en = s.where(F.rlike("sentence", F.lit(EN_PERSON)) & F.rlike("sentence", F.lit(EN_HEALTH_VERB)))
    out = None
    for part, pattern, rule, phrase in ((ko, KO_HEALTH, "ko_health", "건강 문제"), (en, EN_HEALTH, "en_health", "a health condition")):
        found = literal_spans(part.withColumnRenamed("start", "_from"), "sentence", pattern, *keys, "_from")
        found = found.withColumns({"start": F.col("start") + F.col("_from"), "end": F.col("end") + F.col("_from"), "type": F.lit("HEALTH"), "action": F.lit("generalize"), "rule": F.lit(rule), "replacement": F.lit(phrase)}).drop("_from")
        out = found if out is None else out.unionByName(found)
    return out


def organizations(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Names with a company's suffix, but for common first words and for acronyms with a suffix."""
    words = F.split("text", r"\s+")
    acronyms = F.forall(F.slice(words, 1, F.size(words) - 1), lambda w: F.rlike(w, F.lit("^[A-Z]{1,4}$")))
    en = literal_spans(df, text, ORG, *keys).where(~F.element_at(words, 1).isin(*ORG_NOT_FIRST) & ~acronyms).withColumn("rule", F.lit("en_org"))
    ko = literal_spans(df, text, KO_ORG, *keys).withColumn("rule", F.lit("ko_org"))
    return en.unionByName(ko).withColumns({"type": F.lit("ORG"), "action": F.lit("mask")})


def korean_spans(df: DataFrame, text: str, *keys: str, never: frozenset[str] = frozenset()) -> DataFrame:
    """(keys, start, end, text, type, action, rule, replacement): Korean names by title, label or introduction, and
    unique roles, found in the text as its reader sees it, at the raw places.  `never` are words that are no names
    in these texts; placeholders are left alone."""
    kinds, n = dict(df.dtypes), len(keys)
    names = korean.Names(never)

    def found(raw: str) -> list[tuple]:
        view = norm.detection_view(raw) if norm.may_hide(raw) else None
        seen = view.text if view else raw
        blocked = [m.span() for m in re.finditer(f"<{KEY}>", seen)]
        out = []
        for f in [*names.spans(seen), *korean.unique_roles(seen)]:
            if any(f.start < b and a < f.end for a, b in blocked):
                continue
            start, end = view.raw(f.start, f.end) if view else (f.start, f.end)
            out.append((start, end, raw[start:end], f.type, "generalize" if f.replacement else "mask", f.rule, f.replacement))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(n).to_pylist()):
                own = found(raw) if raw and not raw.isascii() else []
                at += [i] * len(own)
                rows += own
            kept = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            made = [pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*keys, "start", "end", "text", "type", "action", "rule", "replacement"])

    return df.select(*keys, text).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start int, end int, text string, type string, action string, rule string, replacement string"]))


def persons(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Names after a label, in Latin letters, and Korean ones by title, label or introduction."""
    labeled = literal_spans(df, text, LABELED_NAME, *keys).withColumns({"type": F.lit("PERSON"), "action": F.lit("mask"), "rule": F.lit("labeled_person")})
    own = korean_spans(df, text, *keys).where("type = 'PERSON'")
    return own.select(*keys, "start", "end", "text", "rule", "type", "action").unionByName(labeled)


def birth_dates(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Dates after a label of birth: the date alone, at the end of the match."""
    group = BIRTH_DATE.rindex("((?:19|20)")
    whole = literal_spans(df, text, BIRTH_DATE[:group] + "(?:" + BIRTH_DATE[group + 1 :], *keys)
    date = F.regexp_extract("text", BIRTH_DATE, 1)
    return whole.withColumn("text", date).withColumn("start", F.col("end") - F.length("text")).withColumns({"type": F.lit("DATE_OF_BIRTH"), "action": F.lit("mask"), "rule": F.lit("birth_date")})


def term_type(term: Column) -> Column:
    """PROJECT, ORG, PERSON or TERM, for a declared term."""
    t = F.trim(term)
    return (
        F.when(F.rlike(t, F.lit(r"(?iu)^(?:프로젝트|project|operation|codename|코드명)\s+\S")), "PROJECT")
        .when(F.rlike(t, F.lit(rf"^(?:[A-Z][A-Za-z&'’\-]*\s+){{1,3}}(?:{ORG_SUFFIX}|Biosystems|Bio|Biosciences|Works|Collective|Agency|Studio|Firm|Foundation|Trust|Fund|Center|Centre|Cooperative|Society|Press)$")), "ORG")
        .when(F.rlike(t, F.lit(rf"^(?:{KO_ORG})$")), "ORG")
        .when(F.rlike(t, F.lit(r"^[A-Z][a-z]+(?: [A-Z][a-z.]+)+$|^[김이박최정강조윤장임한오서신권황안송][가-힣]{1,2}$")), "PERSON")
        .otherwise("TERM")
    )


def situation_kept(value: Column, kind: Column, text: Column | None = None) -> Column:
    """Values that a task works on stay, unless their text (or they themselves) tell of a small group."""
    return situation_value(value, kind) & ~small_group(value if text is None else text)
