"""Text expressions: slugs, tokens, links, dates, truncation, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types whose ids carry the namespace of their document (fixed values).
NAMESPACED_TYPES = ("coverage", "term")


def slug(name: Column) -> Column:
    """Lower case, non-word characters to single underscores, none at the ends; ``entity`` if nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w가-힣]", "_")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(plain, "_+", "_"), F.lit("_")), F.lit("")), F.lit("entity"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def namespace(path: Column) -> Column:
    """The slug of the file's stem without its kind-and-version suffix."""
    return slug(F.regexp_replace(stem(path), r"_(약관|사업방법서|산출방법서)_\d+(_v\d+)?$", ""))


def entity_id(name: Column, entity_type: Column, path: Column, parent: Column | None = None) -> Column:
    own = namespace(path) if parent is None else F.coalesce(F.when(parent != "", slug(parent)), namespace(path))
    return F.when(entity_type.isin(*NAMESPACED_TYPES), F.concat_ws("::", own, slug(name))).otherwise(slug(name))


def id_namespace(entity: Column) -> Column:
    return F.when(F.contains(entity, F.lit("::")), F.substring_index(entity, "::", 1)).otherwise("")


def id_base(entity: Column) -> Column:
    at = F.instr(entity, "::")
    return F.when(at > 0, F.substr(entity, at + 2, F.length(entity))).otherwise(entity)


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def page_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<!--\s*page:(\d+)\s*-->"), F.lit(1)), lambda x: x.cast("int"))


def section_label(text: Column) -> Column:
    """The first and last article that a text names, as a label; empty if none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"제\s*(\d+)\s*조"), F.lit(1)), lambda x: x.cast("int"))))
    one = lambda x: F.concat(F.lit("제"), x.cast("string"), F.lit("조"))
    first, last = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
    return F.when(F.size(found) == 0, "").when(F.size(found) == 1, one(first)).otherwise(F.concat(one(first), F.lit("~"), one(last)))


def tokens(text: Column, dashes: bool = False) -> Column:
    """Different lower-cased tokens of Latin letters, digits and Hangul, in order."""
    pattern = "[a-zA-Z0-9가-힣-]+" if dashes else "[a-zA-Z0-9가-힣]+"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def keyword_hits(words: list[str], text: Column) -> Column:
    """How many of the words occur in the text, in whatever place."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal in B, KB, MB, GB or TB."""
    power = F.when(n > 0, F.least(F.floor(F.log(1024.0, n.cast("double")) + 1e-12), F.lit(4))).otherwise(0)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power.cast("int") + 1)
    return F.concat_ws(" ", F.format_string("%.1f", n / F.pow(F.lit(1024.0), power)), unit)


def ymd(digits: Column) -> Column:
    return F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2))


def effective_date(meta_date: Column, body: Column, file_name: Column) -> Column:
    """The first of: the date in the metadata, a coded date, a labelled date near the top, a plausible bare date near the top, a year and month or a date in the file's name."""
    full = lambda pattern, text: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    top = F.left(body, F.lit(3000))
    label = r"시행일\s*[:：]?\s*(\d{4})[.\-/년](\d{1,2})[.\-/월](\d{1,2})"
    part = lambda i: F.regexp_extract(top, label, i)
    labelled = F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    bare = full(r"(?<!\d)(\d{8})(?!\d)", F.left(body, F.lit(1000)))
    sane = bare.substr(1, 4).cast("int").between(2020, 2030) & bare.substr(5, 2).cast("int").between(1, 12) & bare.substr(7, 2).cast("int").between(1, 31)
    month = full(r"_(\d{4})\.md$", file_name)
    by_month = F.when(month.substr(3, 2).cast("int").between(1, 12), F.concat(F.lit("20"), month.substr(1, 2), F.lit("-"), month.substr(3, 2), F.lit("-01")))
    coded = full(r"\[\w+_D\d+_(\d{8})\]", body)
    in_name = full(r"(\d{8})", stem(file_name))
    return F.coalesce(F.nullif(meta_date, F.lit("")), F.when(coded.isNotNull(), ymd(coded)), labelled, F.when(sane, ymd(bare)), by_month, F.when(in_name.isNotNull(), ymd(in_name)))


def query_date(text: Column) -> Column:
    """A date with dots, dashes, slashes or year and month signs, as yyyy-mm-dd; null if none."""
    p = r"(\d{4})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})"
    part = lambda i: F.regexp_extract(text, p, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def salvaged_json(raw: Column, schema: str) -> Column:
    """A model's answer as a struct: fences go, else the widest braces are tried, else null."""
    clean = F.rtrim(F.trim(F.regexp_replace(raw, r"```(?:json)?\s*", "")), F.lit("`"))
    inner = F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))
    whole = F.when(F.try_parse_json(clean).isNotNull(), clean)
    return F.from_json(F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner)), schema)


def listed(text: Column) -> Column:
    """A comma list as an array without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def highlighted(text: Column, query: str) -> Column:
    """Every case-insensitive occurrence of the query in <mark> tags."""
    import re

    return F.regexp_replace(text, "(?i)" + re.escape(query), "<mark>$0</mark>") if query else text


def gfm_table(rows: Column) -> Column:
    """An array of arrays of cells as a table, the first row as its head; bars in cells are escaped and short rows filled."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    filled = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(filled(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def safe_name(name: Column) -> Column:
    """A name that may be a folder: separators become underscores, 100 characters at most."""
    return F.left(F.translate(name, "/: ", "___"), F.lit(100))


def citation(title: Column, first_page: Column, last_page: Column, date: Column, version: Column) -> Column:
    """The title with its pages, or else its date in brackets, or else its version."""
    pages = F.when(first_page.isNotNull(), F.concat(F.lit("(p."), first_page.cast("string"), F.when(last_page > first_page, F.concat(F.lit("-"), last_page.cast("string"))).otherwise(""), F.lit(")")))
    dated = F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("["), date, F.lit("]")))
    versioned = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("("), version, F.lit(")")))
    return F.concat_ws(" ", title, F.coalesce(pages, dated, versioned))


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, itself where there is none."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, code), code)


def usage(prompt: Column, answer: Column) -> Column:
    """Characters of a question and its answer, and of both."""
    a, b = F.length(F.coalesce(prompt, F.lit(""))).cast("long"), F.length(F.coalesce(answer, F.lit(""))).cast("long")
    return F.struct(a.alias("prompt"), b.alias("completion"), (a + b).alias("total"))


def letters(text: Column) -> Column:
    """How many Hangul syllables and how many Latin letters a text has."""
    return F.struct(F.regexp_count(text, F.lit("[가-힣]")).cast("long").alias("hangul"), F.regexp_count(text, F.lit("[A-Za-z]")).cast("long").alias("latin"))


def inside_root(path: Column) -> Column:
    """Whether a relative path stays below its root once its dots are resolved: no step goes above it."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, x: F.struct((a["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce((depth["least"] >= 0) & ~F.startswith(path, F.lit("/")), F.lit(False))


def attempt_timeout(kilobytes: Column, weight: Column, attempt: Column) -> Column:
    """Seconds allowed: 600 for each 8 KB (8 at least), times the weight, doubled with every attempt."""
    return F.lit(600.0) * F.greatest(kilobytes, F.lit(8.0)) / 8 * weight * F.pow(F.lit(2.0), attempt)
