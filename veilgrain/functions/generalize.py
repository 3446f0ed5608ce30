"""Generalization of ages, dates, health terms and kept situation values, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Age wordings, Korean numerals, date and birth-year wordings.
AGE_PATTERNS = (
    r"(\d{1,3})\s*(?:세|살)",
    r"(?i)(?<!\d)(\d{1,3})\s*-?\s*years?\s*-?\s*old",
    r"(?i)\b(?:aged?|turned|turning|turns)\s+(\d{1,3})\b",
    r"(?i)\b(\d{1,3})\s*(?:yo|y/o|yrs?)\b",
    r"(?:올해|나이는?|나이가)\s*(\d{1,3})(?!\d)",
)
KO_TENS = {"스물": 20, "스무": 20, "서른": 30, "마흔": 40, "쉰": 50, "예순": 60, "일흔": 70, "여든": 80, "아흔": 90}
KO_ONES = {"하나": 1, "한": 1, "둘": 2, "두": 2, "셋": 3, "세": 3, "넷": 4, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9}
DATE_YMD = r"(?<!\d)((?:19|20)\d{2})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})"
DATE_NAMED = rf"(?i)\b({'|'.join(MONTHS)})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)\d{{2}})\b"
DATE_MDY = r"(?<!\d)(\d{1,2})[/.](\d{1,2})[/.]((?:19|20)\d{2})(?!\d)"
BORN_YEAR = r"(?i)((?:19|20)\d{2})\s*년\s*생|(?<!\d)(\d{2})년생|\bborn\s+(?:in\s+)?((?:19|20)\d{2})\b"
BIRTH_LABEL = r"(?i)(?:생년월일|\bDOB\b|\bD\.O\.B\.?|date of birth|birth\s*date|birthday|\bborn(?:\s+on)?)\s*(?:is|was|:|-)?\s*"
BIRTH_DATE = BIRTH_LABEL + rf"((?:19|20)\d{{2}}\s*[-./년]\s*\d{{1,2}}\s*[-./월]\s*\d{{1,2}}(?:\s*일)?|\d{{1,2}}[/.]\d{{1,2}}[/.](?:19|20)\d{{2}}|(?:{'|'.join(MONTHS)})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}})"
# Health categories, the first that matches counts.
HEALTH = (
    (r"추간판|디스크|disc herniation|herniated disc|slipped disc", "척추 질환", "a spinal disc condition"),
    (r"양극성|조울|bipolar", "기분장애", "a mood disorder"),
    (r"우울|depress", "우울장애", "a depressive disorder"),
    (r"공황|불안장애|panic|anxiety", "불안장애", "an anxiety disorder"),
    (r"조현|schizophren|psychosis", "정신질환", "a psychiatric disorder"),
    (r"ADHD|자폐|autism|발달장애", "신경발달장애", "a neurodevelopmental condition"),
    (r"파킨슨|치매|알츠하이머|parkinson|dementia|alzheimer", "신경퇴행성 질환", "a neurodegenerative disease"),
    (r"뇌전증|간질|epilep|seizure", "신경계 질환", "a neurological condition"),
    (r"HIV|AIDS|에이즈|간염|hepatitis", "만성 감염 질환", "a chronic infection"),
    (r"암|cancer|leukemia|lymphoma|백혈병|림프종|종양|tumou?r", "암", "cancer"),
    (r"당뇨|diabet|insulin|인슐린", "당뇨병", "diabetes"),
    (r"고혈압|심근경색|협심증|부정맥|심부전|hypertension|heart", "심혈관 질환", "a cardiovascular condition"),
    (r"천식|asthma|COPD|폐렴|pneumonia", "호흡기 질환", "a respiratory condition"),
    (r"난임|불임|체외수정|시험관|IVF|infertil", "난임 치료", "fertility treatment"),
    (r"임신|pregnan", "임신", "pregnancy"),
    (r"중독|addiction|alcoholism|substance use", "중독 질환", "a substance use disorder"),
    (r"섭식|거식|폭식|anorexia|bulimia|eating disorder", "섭식장애", "an eating disorder"),
)
VAGUE_HEALTH = ("건강 문제", "질병", "a health condition", "a medical condition")


def text_lang(text: Column) -> Column:
    """ko where Hangul makes up a fifth of the letters, else en."""
    hangul, latin = F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((hangul > 0) & (hangul * 4 >= latin), "ko").otherwise("en")


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def age_of(text: Column) -> Column:
    """The age a text states, between 1 and 119, or null."""
    found = [_number(text, p) for p in AGE_PATTERNS]
    ones = sorted(KO_ONES, key=len, reverse=True)
    spoken = rf"({'|'.join(KO_TENS)})({'|'.join(ones)})?(?:\s*살)?"
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    ko = F.try_element_at(table(KO_TENS), F.regexp_extract(text, spoken, 1)) + F.coalesce(F.try_element_at(table(KO_ONES), F.regexp_extract(text, spoken, 2)), F.lit(0))
    return F.coalesce(*[F.when((a > 0) & (a < 120), a) for a in found], ko)


def date_in(text: Column) -> Column:
    """The first date that a text states in one of three writings, or null."""

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")

    ymd = made(_number(text, DATE_YMD, 1), _number(text, DATE_YMD, 2), _number(text, DATE_YMD, 3))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(text, DATE_NAMED, 1), 1, 3))), F.lit(0))
    named = made(_number(text, DATE_NAMED, 3), month.cast("int"), _number(text, DATE_NAMED, 2))
    mdy = made(_number(text, DATE_MDY, 3), _number(text, DATE_MDY, 1), _number(text, DATE_MDY, 2))
    has = lambda p: F.rlike(text, F.lit(p))
    return F.coalesce(F.when(has(DATE_YMD), ymd), F.when(has(DATE_NAMED), named), F.when(has(DATE_MDY), mdy))


def birth_year(text: Column, as_of: Column) -> Column:
    """A year of birth; two digits above the year of `as_of` are of the last century."""
    short = _number(text, BORN_YEAR, 2)
    return F.coalesce(_number(text, BORN_YEAR, 1), F.when(short > F.year(as_of) % 100, short + 1900).otherwise(short + 2000), _number(text, BORN_YEAR, 3), F.year(date_in(text)))


def age_from_birth(born: Column, as_of: Column) -> Column:
    early = (F.month(as_of) * 100 + F.day(as_of)) < (F.month(born) * 100 + F.day(born))
    return F.year(as_of) - F.year(born) - early.cast("int")


def decade_phrase(age: Column, lang: Column, pronoun: str = "their") -> Column:
    d = (F.floor(age / 10) * 10).cast("int")
    ko = F.when(d == 0, "10세 미만").otherwise(F.concat(d.cast("string"), F.lit("대")))
    en = F.when(d == 10, f"in {pronoun} teens").when(d > 10, F.concat(F.lit(f"in {pronoun} "), d.cast("string"), F.lit("s"))).otherwise("under 10")
    return F.when(lang == "ko", ko).otherwise(en)


def birth_decade_phrase(year: Column, lang: Column) -> Column:
    d = (F.floor(year / 10) * 10).cast("int").cast("string")
    return F.when(lang == "ko", F.concat(d, F.lit("년대생"))).otherwise(F.concat(F.lit("born in the "), d, F.lit("s")))


def health_category(text: Column, lang: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?iu){p}")), F.when(lang == "ko", ko).otherwise(en)) for p, ko, en in HEALTH])


def category_replacement(original: Column, replacement: Column, lang: Column) -> Column:
    """A category instead of a vague or missing replacement; null where the given one is fine."""
    vague = replacement.isNull() | (replacement == "") | replacement.isin(*VAGUE_HEALTH)
    care = F.regexp_extract(F.trim(original), "(진단|수술|처방|치료)$", 1)
    category = health_category(original, lang)
    return F.when(vague, F.when((lang == "ko") & (care != ""), F.concat(category, F.lit(" "), care)).otherwise(category))


def generalization_ok(original: Column, replacement: Column) -> Column:
    """A replacement may not be empty, long, a placeholder, hold control characters, or give the original or
    a token of it away."""
    bad = (
        (F.trim(replacement) == "")
        | (F.length(replacement) > 120)
        | F.rlike(replacement, F.lit(r"<[A-Z][A-Z_]*_\d+>|\[\[|\]\]"))
        | F.rlike(replacement, F.lit(r"[\p{Cntrl}\"\\]"))
        | F.contains(F.lower(replacement), F.lower(F.trim(original)))
        | F.arrays_overlap(F.filter(F.split(F.lower(original), r"[^\p{L}\p{N}]+"), lambda t: F.rlike(t, F.lit(r"^[0-9]{3,}$"))), F.split(F.lower(replacement), r"[^\p{L}\p{N}]+"))
    )
    return ~F.coalesce(bad, F.lit(True))


# Endings of diagnoses, what makes one a description of a person, cues of sums and of accounts, titles.
DIAGNOSIS = r"^[\w\s\-'’+/]{0,30}?(?:증후군|탈출증|증|병|염|암|장애|질환|종양|감염|결핍|양성|음성)$|(?i)^[\w\s\-'’+/]{0,30}?(?:disease|syndrome|disorder|deficiency|infection|herniation|itis|carcinoma|lymphoma|melanoma|sarcoma|glaucoma|myeloma|blastoma|glioma|[-\s]positive|[-\s]negative)$"
PAPERS = r"(?:자격|영수|신분|학생|사원|면허|등록|수료|보|인|확인|허가|합격|졸업|출입|공무원|회원|이용|증명)증$"
OF_A_PERSON = r"(?i)\b(?:only|sole|first|youngest|oldest|with|at|in|of|my|her|his|their|who)\b|유일|최초|하나뿐|에서|의\s"
TELLS_OF_SOMEONE = r"(?i)\b(?:only|sole|first|youngest|oldest|who|that|which|whose|my|her|his|their|our)\b|유일|최초|하나뿐|혼자|우리|내가|제가"
SUMS = r"(?i)factorial|팩토리얼|\bequal(?:s)?\b|\bprime\b|소수|\bdivisible\b|약수|배수|제곱|\bsquare root\b|\bsum of\b|곱하기|나누기|더하기|빼기|계산|\bcalculate\b|\bcompute\b|[×÷=^]"
ACCOUNTS = r"(?i)account|acct|card|routing|iban|계좌|카드|번호|\bID\b|number|#|no\."
BIRTHS = r"(?i)생년월일|생일|출생|태어났|태어난|년생|\bDOB\b|date of birth|birth\s*date|\bborn\b|birthday"


def _bare(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(value), r"^[.,;:()]+|[.,;:()]+$", ""))


def common_health_term(value: Column, patterns: tuple[str, ...]) -> Column:
    """A term of the health rules (`patterns`), short and without a number of three digits."""
    held = F.rlike(value, F.lit(patterns[0]))
    for p in patterns[1:]:
        held = held | F.rlike(value, F.lit(p))
    return (F.length(F.trim(value)) <= 40) & ~F.rlike(value, F.lit(r"\d{3,}")) & held


def diagnosis_term(value: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Nothing but a diagnosis or a finding, by its ending or the health rules; not a phrase that tells of someone."""
    t = _bare(value)
    short = (t != "") & (F.length(t) <= 48) & (F.size(F.split(t, r"\s+")) <= 6) & ~F.rlike(t, F.lit(r"\d{3,}"))
    shaped = F.rlike(t, F.lit(f"(?U){DIAGNOSIS.replace('|(?i)', '|(?iU)')}"))
    known = shaped | common_health_term(t, patterns) if patterns else shaped
    return short & ~F.rlike(t, F.lit(f"(?U){OF_A_PERSON}")) & ~F.rlike(t, F.lit(PAPERS)) & known


def health_term(value: Column) -> Column:
    """A short term that can stay as it is: four words at most, none of which tells of someone."""
    t = _bare(value)
    return (t != "") & (F.length(t) <= 32) & (F.size(F.split(t, r"\s+")) <= 4) & ~F.rlike(t, F.lit(r"\d{3,}")) & ~F.rlike(t, F.lit(f"(?U){TELLS_OF_SOMEONE}"))


def _around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    low = F.greatest(start - before, F.lit(0))
    return F.substring(text, low + 1, end + after - low)


def is_birth_date(text: Column, start: Column, end: Column) -> Column:
    """A cue of birth stands within 24 characters before a place, or 6 after it."""
    return F.rlike(_around(text, start, end, 24, 6), F.lit(f"(?U){BIRTHS}"))


def arithmetic_number(text: Column, start: Column, end: Column) -> Column:
    """A run of four digits or more that its surroundings compute with, without a label of an account before it."""
    value = F.trim(F.substring(text, start + 1, end - start))
    before = F.substring(text, F.greatest(start - 30, F.lit(0)) + 1, start - F.greatest(start - 30, F.lit(0)))
    return F.rlike(value, F.lit(r"^\d{4,}$")) & F.rlike(_around(text, start, end, 60, 60), F.lit(f"(?U){SUMS}")) & ~F.rlike(before, F.lit(f"(?U){ACCOUNTS}"))


# Amounts, measures, laboratory values, durations, dates, schedules, and marks of a small group.
_MONTH = "|".join(MONTHS)
_CLOCK = r"(?:(?:오전|오후|새벽|저녁|밤|아침)\s*)?\d{1,2}\s*시(?:\s*\d{1,2}\s*분|\s*반)?|\d{1,2}:\d{2}(?:\s*[ap]\.?m\.?)?|\d{1,2}\s*[ap]\.?m\.?"
MONEY = (
    r"(?:약\s*|about\s+|~)?[$€£₩¥]\s*[\d,.]+\s*(?:[kKmMbB]|million|billion|thousand)?|(?:약\s*)?[\d,.]+\s*(?:만|억|천|백)?\s*(?:만\s*)?(?:원|달러|엔|유로|dollars?|usd|krw|eur|won)|(?:약\s*)?[\d,.]+\s*(?:만|억|천)\s*원?"
)
MEASURE = (
    r"(?:[A-Za-z가-힣][\w가-힣()/\-]{0,15}[\s:]+){0,3}[<>≤≥~]?\s*\d+(?:[.,]\d+)?\s*(?:%|퍼센트|mg|㎎|g|kg|mcg|μg|ug|ml|mL|㎖|l|L|IU|units?|mmHg|mmol/L|mg/dL|g/dL|bpm|회|정|알|cm|mm|km|kcal|도|℃|°C|°F|pt|포인트|점|배)(?:/(?:일|day|d|회|kg|L|dL))?\s*"
)
LABORATORY = r"(?:eGFR|GFR|HbA1c|A1c|LDL|HDL|BMI|PSA|TSH|INR|CRP|AST|ALT|ESR|WBC|RBC|PLT|Hb|Hgb|공복\s*혈당|혈당|당화혈색소|혈압)\s*[:=]?\s*[<>≤≥~]?\s*\d+(?:[.,/]\d+)?\s*%?"
DURATION = r"(?:약\s*)?\d+(?:\.\d+)?\s*(?:주|개월|달|년|일|시간|분|weeks?|months?|years?|days?|hours?)(?:\s*(?:간|째|차|분))?|(?:one|two|three|four|five|six|seven|eight|nine|ten|twelve)\s+(?:weeks?|months?|years?|days?)"
PLAIN_DATE = (
    r"(?:(?:19|20)\d{2}\s*[-./년]\s*)?\d{1,2}\s*[-./월]\s*\d{1,2}\s*일?|\d{1,2}\s*월(?:\s*\d{1,2}\s*일)?|(?:19|20)\d{2}\s*년(?:\s*\d{1,2}\s*월)?(?:\s*\d{1,2}\s*일)?"
    rf"|(?:{_MONTH})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{_MONTH})[a-z]*(?:,?\s+\d{{4}})?|(?:19|20)\d{{2}}[-/.]\d{{2}}(?:[-/.]\d{{2}})?"
)
SCHEDULE = rf"(?:{_CLOCK})(?:\s*(?:,|/|·|~|-|–|to|and|및|와|과|\s)\s*(?:{_CLOCK}))*"
MONEY_INSIDE = r"[$€£₩¥]\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:[kKmMbB]\b|million|billion|thousand))?|\d[\d,]*(?:\.\d+)?\s*(?:만|억|천)?\s*(?:원|달러|dollars?|usd|krw|eur|won)"
DURATION_INSIDE = r"\d+\s*(?:일|주|개월|달|년|시간|days?|weeks?|months?|years?|hours?)"
COUNT_INSIDE = r"\d[\d,]*\s*(?:shares?|units?|times|people|주|건|명|회|개|장|%)"
SMALL_GROUP = r"(?i)\d+\s*학년\s*\d+\s*반|쌍둥이|유일|하나뿐|단\s*한\s*명|혼자만|\bonly\b|\bsole\b|\btwins?\b|\bclass of \d+|\b\d+-(?:person|member|employee|student)\b|\bour (?:class|ward|unit|floor)\b"


def _whole(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(f"(?iU)^(?:{pattern})$"))


def is_amount(value: Column) -> Column:
    """An amount of money, one with a label, or one in a short phrase without another number or a name."""
    labeled = _whole(value, rf"(?:[A-Za-z가-힣]{{1,10}}\s*){{1,3}}[:=]?\s*(?:{MONEY})")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, f"(?iU){MONEY_INSIDE}", " "), f"(?iU){DURATION_INSIDE}", " "), f"(?iU){COUNT_INSIDE}", " ")
    inside = (F.length(value) <= 100) & F.rlike(value, F.lit(f"(?iU){MONEY_INSIDE}")) & ~F.rlike(rest, F.lit(r"\d|[A-Z][a-z]+\s+[A-Z][a-z]+"))
    return _whole(value, MONEY) | labeled | inside


def situation_value(value: Column, kind: Column) -> Column:
    """What a task works on: an amount, a measure, a duration, a date or a schedule.  With a type, only what it may hold
    counts: an ID number only if it is a date or schedule, a financial value only if it is an amount or schedule."""
    t = F.trim(F.regexp_replace(F.trim(value), r"^[.,;:()]+|[.,;:()]+$", ""))
    other = is_amount(t) | _whole(t, MEASURE) | _whole(t, LABORATORY) | _whole(t, DURATION) | _whole(t, PLAIN_DATE)
    own = F.when(kind == "ID_NUMBER", _whole(t, PLAIN_DATE)).when(kind == "FINANCIAL", is_amount(t)).otherwise(other)
    return _whole(t, SCHEDULE) | own


def small_group(text: Column) -> Column:
    """Marks of a group so small that what is said of it narrows someone down."""
    return F.rlike(text, F.lit(f"(?U){SMALL_GROUP}"))
