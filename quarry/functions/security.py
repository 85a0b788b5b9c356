"""Security expressions: personal data, sensitivity grades, prompt injection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Personal-data patterns and their full masks, in the order of masking (fixed values).
PII = {
    "resident_id": (r"\d{6}-[1-4]\d{6}", "******-*******"),
    "phone": (r"01[016789]-?\d{3,4}-?\d{4}", "***-****-****"),
    "card_number": (r"\d{4}-?\d{4}-?\d{4}-?\d{4}", "****-****-****-****"),
    "email": (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "***@***.***"),
    "business_registration_number": (r"\d{3}-\d{2}-\d{5}", "***-**-*****"),
    "passport_number": (r"[A-Z]{1,2}\d{7,8}", "**********"),
    "driver_license_number": (r"\d{2}-\d{2}-\d{6}-\d{2}", "**-**-******-**"),
    "bank_account_number": (r"(?:\d{3}-\d{2}-\d{6}|\d{3}-\d{6}-\d{2}-\d{3}|\d{4}-\d{4}-\d{4}|\d{3}-\d{4}-\d{4}-\d{2})", "****-****-****"),
}

#: Patterns of the most and the less sensitive grade (fixed values).
GRADE3 = (
    r"\d{6}[-]\d{7}", r"\d{3}[-]\d{2}[-]\d{5}", r"\d{4}[-]\d{4}[-]\d{4}[-]\d{4}", r"010[-]\d{4}[-]\d{4}",
    r"질병\s*이력", r"사고\s*이력", r"진단\s*내역", r"치료\s*이력",
    r"고객\s*(?:번호|ID|아이디)", r"증권\s*번호", r"계약\s*번호",
    r"피보험자\s*(?:이름|성명|주소)", r"수익자\s*(?:이름|성명)",
    r"계좌\s*번호", r"보험금\s*(?:청구|지급)\s*내역",
)
GRADE2 = (
    r"사규", r"사업방법서", r"내규", r"매뉴얼",
    r"언더라이팅\s*(?:기준|가이드)", r"UW\s*(?:기준|가이드)",
    r"보상\s*(?:기준|매뉴얼|가이드)", r"심사\s*(?:기준|규정)",
    r"대외비", r"사내\s*한정", r"내부\s*(?:문서|자료)",
    r"산출방법서", r"요율\s*(?:표|기준)",
)
GRADE2_PATHS = ("사업방법서", "산출방법서", "uw", "내규")
SCANNED = 5000

#: Prompt-injection patterns with the weight of each group (fixed values).
INJECTION = {
    "injection_en": (0.45, (r"ignore\s+(all\s+)?previous\s+instructions", r"you\s+are\s+now\s+", r"system\s*:\s*", r"<\|im_start\|>", r"```\s*system")),
    "injection_ko": (0.45, (r"이전\s*지시를?\s*무시", r"시스템\s*프롬프트", r"너는\s*이제부터", r"역할을?\s*바꿔", r"이전\s*(명령|지침)을?\s*(모두\s*)?(무시|잊어)", r"새로운\s*역할")),
    "jailbreak": (0.35, (
        r"\bDAN\b", r"do\s+anything\s+now", r"jailbreak(ed)?", r"hypothetically[\s,]", r"in\s+a\s+hypothetical\s+scenario",
        r"pretend\s+(you\s+are|to\s+be)\s+", r"act\s+as\s+(if\s+)?(you\s+are\s+)?an?\s+", r"role\s*play\s+as\s+",
        r"\[INST\]", r"<\|endoftext\|>", r"<\|im_end\|>", r"developer\s+mode\s+(enabled|on|activated)",
    )),
}
#: What every match of these patterns holds, in their order and in small letters: a text without it needs no pattern.
CUES = {
    "injection_en": ("previous", "now", "system", "<|im_start|>", "```"),
    "injection_ko": ("이전", "시스템", "너는", "역할", "이전", "새로운"),
    "jailbreak": ("dan", "anything", "jailbreak", "hypothetically", "hypothetical", "pretend", "act", "role", "[inst]", "<|endoftext|>", "<|im_end|>", "developer"),
}
LONG_INPUT, THRESHOLD = 10_000, 0.7


def _pii(kind: str) -> str:
    """The pattern of a kind, digits of every script."""
    return "(?U)" + PII[kind][0]


def mask_full(text: Column) -> Column:
    """Every kind's fixed mask, kind after kind.  All kinds but e-mail hold two digits in a row, and masks hold none, so most texts need no pattern."""

    def masked(kinds: list[str]) -> Column:
        out = text
        for kind in kinds:
            out = F.regexp_replace(out, _pii(kind), PII[kind][1])
        return out

    digits, at = text.rlike(r"(?U)\d\d"), F.contains(text, F.lit("@"))
    return F.when(digits & at, masked(list(PII))).when(digits, masked([k for k in PII if k != "email"])).when(at, masked(["email"])).otherwise(text)


def _mask_found(text: Column, shown) -> Column:
    """Matches of any kind replaced by shown(match), in one pass, so that no mask is masked again."""
    pattern = "(?U)" + "|".join(f"(?:{p})" for p, _ in PII.values())
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), shown), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, b)), "")


def mask_partial(text: Column) -> Column:
    """All but the last four characters of a match as stars."""
    return _mask_found(text, lambda m: F.when(F.length(m) <= 4, F.repeat(F.lit("*"), F.length(m))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(m) - 4), F.right(m, F.lit(4)))))


def mask_hash(text: Column) -> Column:
    """A match's SHA-256 in its place."""
    return _mask_found(text, lambda m: F.sha2(m, 256))


def pii_findings(text: Column) -> Column:
    """All matches of every kind as structs of kind, start (from 0), length and masked text, by start; matches of different kinds may overlap."""
    every = [_found(text, kind, _pii(kind), mask) for kind, (_, mask) in PII.items()]
    return F.array_sort(F.coalesce(F.concat(*every), F.array().cast("array<struct<start:int,length:int,kind:string,masked:string>>")))


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value computed once for all places in which it stands."""
    return F.transform(F.array(value), made)[0]


def _running(numbers: Column) -> Column:
    """The running sums of an array, block by block: some n times the root of n additions for n numbers."""

    def sums(n: Column) -> Column:
        width = F.ceil(F.sqrt(F.greatest(F.size(n), F.lit(1)))).cast("int")
        total = lambda first, many: F.aggregate(F.slice(n, first, many), F.lit(0), lambda a, x: a + x)
        heads = F.transform(F.sequence(F.lit(0), width), lambda b: total(F.lit(1), b * width))
        block = lambda i: F.floor(i / width).cast("int")
        return _bound(heads, lambda h: F.transform(n, lambda _, i: F.get(h, block(i)) + total(block(i) * width + 1, i - block(i) * width + 1)))

    return _bound(numbers, sums)


def _found(text: Column, kind: str, pattern: str, mask: str) -> Column:
    """Matches with their places: a match starts after all that lies between matches, and all matches, before it."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), F.concat(F.array(F.lit("")), found), lambda between, before: F.length(between) + F.length(before))
        starts = F.slice(_running(steps), F.lit(1), F.size(found))
        return F.zip_with(found, starts, lambda m, at: F.struct(at.alias("start"), F.length(m).alias("length"), F.lit(kind).alias("kind"), F.lit(mask).alias("masked")))

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def masked_response(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """A result with personal data masked in every text column but those to skip."""
    return df.withColumns({c: mask_full(F.col(c)) for c, kind in df.dtypes if kind == "string" and c not in skip})


def pii_counts(text: Column) -> dict[str, Column]:
    return {kind: F.regexp_count(text, F.lit(_pii(kind))).cast("long") for kind in PII}


def _hits(text: Column, patterns: Sequence[str], flag: str, mark: str) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(flag + p), F.lit(mark + p)) for p in patterns]))


def classified(text: Column, path: Column) -> dict[str, Column]:
    """grade (1 open, 2 internal, 3 sensitive) and what it rests on; the start of a text is what counts."""
    top = F.left(F.coalesce(text, F.lit("")), F.lit(SCANNED))
    none = F.array().cast("array<string>")
    hangul, digits = top.rlike("[가-힣]"), top.rlike(r"(?U)\d")  # a pattern without digits needs the former
    numbers, words = ([p for p in GRADE3 if (r"\d" in p) == kind] for kind in (True, False))  # numbers come first
    three = F.slice(F.concat(F.when(digits, _hits(top, numbers, "(?U)", "G3:")).otherwise(none), F.when(hangul, _hits(top, words, "(?U)", "G3:")).otherwise(none)), 1, 2)
    low = F.lower(F.coalesce(path, F.lit("")))
    by_path = F.array_compact(F.array(F.when(sum((F.contains(low, F.lit(k)).cast("int") for k in GRADE2_PATHS), F.lit(0)) > 0, F.lit("G2:filepath"))))
    two = F.concat(F.when(hangul, _hits(top, GRADE2, "(?iU)", "G2:")).otherwise(none), by_path)
    both = F.transform(F.array(F.struct(three.alias("three"), two.alias("two"))), _graded)  # found once, used more than once
    return {"grade": both[0]["grade"], "detected": both[0]["detected"]}


def _graded(hits: Column) -> Column:
    three, two = F.size(hits["three"]) > 0, F.size(hits["two"]) > 0
    grade = F.when(three, 3).when(two, 2).otherwise(1)
    return F.struct(grade.alias("grade"), F.when(three, hits["three"]).otherwise(hits["two"]).alias("detected"))


def grade_policy(grade: Column) -> dict[str, Column]:
    """What a grade allows (fixed values)."""
    return {"learning_allowed": grade == 1, "rag_allowed": grade < 3, "external_allowed": F.lit(False), "anonymize_required": grade != 2}


def rag_access(grade: Column, roles: Column) -> Column:
    return (grade < 3) | F.array_contains(roles, "admin")


def _injection_hits(text: Column) -> dict[str, Column]:
    """How many patterns of each group are found.  Cases are folded as the patterns do it, dotted and dotless i and long s too."""
    folded = text
    for letter, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    folded = F.lower(folded)
    found = lambda cue, p: (F.contains(folded, F.lit(cue)) & text.rlike("(?iU)" + p)).cast("int")
    return {group: sum((found(cue, p) for cue, p in zip(CUES[group], patterns, strict=True)), F.lit(0)) for group, (_, patterns) in INJECTION.items()}


def injection_risk(text: Column) -> Column:
    """0 to 1: a long input counts a little, the first pattern of a group its weight, three more a share of it."""
    t = F.coalesce(text, F.lit(""))
    score = F.when(F.length(t) > LONG_INPUT, 0.15).otherwise(0.0)
    for group, hits in _injection_hits(t).items():
        weight = INJECTION[group][0]
        score = score + F.when(hits > 0, F.lit(weight) + F.least(hits - 1, F.lit(3)) * F.lit(weight * 0.15)).otherwise(0.0)
    return F.least(F.round(score, 4), F.lit(1.0))


def injection_found(text: Column) -> Column:
    return sum(_injection_hits(F.coalesce(text, F.lit(""))).values(), F.lit(0)) > 0


def sanitised(text: Column) -> dict[str, Column]:
    """status (ok or blocked), the cleaned text (null if blocked) and the risk."""
    cut = F.left(F.coalesce(text, F.lit("")), F.lit(LONG_INPUT))
    risk = injection_risk(cut)
    blocked = (risk >= THRESHOLD) | injection_found(cut)
    return {"status": F.when(blocked, "blocked").otherwise("ok"), "clean": F.when(~blocked, F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")), "risk": risk}
