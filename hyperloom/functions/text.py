"""String functions as column expressions: everything stays in the JVM.

Java's word boundary and case folding are ASCII only unless told otherwise, so patterns carry (?iu) and explicit
look-arounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hyperloom import schema

NOT_AFTER, NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space other than the space itself.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(" " + WHITE))


def single_spaces(c: Column) -> Column:
    """White space runs as one space; a pattern runs only over texts that have runs."""
    spaced = F.translate(c, WHITE, " " * len(WHITE))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)


def normalize_value(c: Column | str) -> Column:
    """Stripped, lower case, white space as single spaces."""
    return F.lower(single_spaces(strip(c)))


def entity_key(kind: Column | str, value: Column | str) -> Column:
    return F.concat(col(kind), F.lit(":"), normalize_value(value))


META_PREFIXES = ["Role", "RelationType", "NumericBase"]


def normalize_key(key: Column | str) -> Column:
    """Semantic keys normalise what follows the first colon; roles and relation types keep their case; numeric
    bases normalise the middle and keep the end they stand for."""
    key = col(key)
    prefix = F.substring_index(key, ":", 1)
    rest = F.regexp_replace(key, r"^[^:]*:", "")
    middle = F.regexp_replace(rest, r":(min|max)$", "")
    end = F.regexp_extract(rest, r"(:(?:min|max))$", 1)
    return (
        F.when(~F.contains(key, F.lit(":")), strip(key))
        .when(prefix.isin("Role", "RelationType"), F.concat(prefix, F.lit(":"), strip(rest)))
        .when(prefix == "NumericBase", F.concat(prefix, F.lit(":"), normalize_value(middle), end))
        .otherwise(F.concat(prefix, F.lit(":"), normalize_value(rest)))
    )


def is_semantic_key(key: Column | str) -> Column:
    return F.contains(col(key), F.lit(":")) & ~F.substring_index(col(key), ":", 1).isin(META_PREFIXES)


#: name, optional separator, optional operator, number, unit. `<=` and `>=` are read as `≤` and `≥`.
NUMERIC = r"^([^0-9:=<>≤≥\s]+)\s*[:=]?\s*(<=|>=|[<>≤≥=])?\s*([-+]?\d*(?:[.,]\d+)?)\s*([\s\S]*)$"
#: The same for names of several words, which end before a separator, an operator or a digit.
NUMERIC_WORDS = NUMERIC.replace(r"≥\s]+)", r"≥]+?)(?=\s*[:=<>≤≥0-9])")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numeric_property(value: Column | str, multiword_names: bool = False) -> Column:
    """struct(name, op, number, unit), null where the text isn't a numeric property."""

    def read(p: Column) -> Column:
        number = F.replace(p[2], F.lit(","), F.lit(".")).try_cast("double")
        op = F.when(p[1] == "<=", "≤").when(p[1] == ">=", "≥").otherwise(p[1])
        return F.when((F.size(p) == 4) & number.isNotNull(), F.struct(strip(p[0]).alias("name"), op.alias("op"), number.alias("number"), strip(p[3]).alias("unit")))

    return bound(F.split(F.regexp_replace(strip(value), NUMERIC_WORDS if multiword_names else NUMERIC, "$1\u0001$2\u0001$3\u0001$4"), "\u0001"), read)


def property_range(name: Column, unit: Column) -> Column:
    """struct(low, high): first match wins."""

    def high(low: Column) -> Column:
        has = lambda *words: F.coalesce(reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words)), F.lit(False))
        return (
            F.when(has("ph"), 14.0)
            .when(has("температура", "temp"), 1200.0)
            .when(has("плотность", "density"), 1000.0)
            .when(F.contains(unit, F.lit("%")) | has("выход", "извлечение", "светлость"), 100.0)
            .otherwise(1000.0)
        )

    return F.struct(F.lit(0.0).alias("low"), bound(F.lower(name), high).alias("high"))


def position_in_range(n: Column) -> Column:
    """Where a parsed numeric property lies in its range, 0 to 1; inequalities stand for the middle of their half."""

    def place(r: Column) -> Column:
        number = F.when(n["op"].isin("<", "≤"), (r["low"] + n["number"]) / 2).when(n["op"].isin(">", "≥"), (n["number"] + r["high"]) / 2).otherwise(n["number"])
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (number - r["low"]) / (r["high"] - r["low"])))

    return F.when(n.isNotNull(), bound(property_range(n["name"], n["unit"]), place))  # nulls are no numbers, which greatest and least skip


def property_position(value: Column | str) -> Column:
    return bound(numeric_property(value), position_in_range)


def slug(filename: Column | str, longest: int = 32) -> Column:
    base = F.regexp_replace(F.regexp_extract(col(filename), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(F.upper(base), r"[^A-Za-z0-9Ѐ-ӿ]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(F.when(clean == "", "DOC").otherwise(clean), 1, longest), r"-+$", "")


CODE = r"^([A-ZА-Яa-zа-я]+)-(\d+)-(\d{4})$"


def normalize_code(code: Column | str) -> Column:
    """Dashes and spaces become `-`; a one-digit middle number is padded."""
    clean = F.regexp_replace(col(code), r"[\s\-–—\u0096]+", "-")
    part = lambda i: F.regexp_extract(clean, CODE, i)
    number = F.when(F.length(part(2)) == 1, F.concat(F.lit("0"), part(2))).otherwise(part(2))
    return F.when(clean.rlike(CODE), F.concat_ws("-", F.upper(part(1)), number, part(3))).otherwise(F.upper(clean))


# What tells code from text.
CODE_FENCE = r"(?m)\A\s*```"
CODE_KEYWORD = r"(?im)(?:^|\n)\s*(?:import\s+\w+|from\s+\w+\s+import|def\s+\w+\s*\(|class\s+\w+\s*[:\(]|function\s+\w+\s*\(|console\.log|#!/usr/bin|package\s+\w+)"
CODE_MARK = r"[{};=<>]|::|->|=>"


def is_code_like(text: Column | str, monospace: Column | bool = False) -> Column:
    """A fence, a keyword in monospace, two keywords on two lines, or a keyword among much punctuation."""
    body = strip(F.coalesce(col(text), F.lit("")))
    mono = F.lit(monospace) if isinstance(monospace, bool) else monospace
    lines = F.size(F.filter(F.split(body, r"\r?\n"), lambda x: strip(x) != ""))
    words, marks = F.regexp_count(body, F.lit(CODE_KEYWORD)), F.regexp_count(body, F.lit(CODE_MARK))
    dense = (marks > 0) & ((marks / F.greatest(F.length(body), F.lit(1)) >= 0.015) | (lines >= 2))
    return (body != "") & (body.rlike(CODE_FENCE) | (mono & (words >= 1)) | ((words >= 2) & (lines >= 2)) | ((words >= 1) & dense))


def heading_level(style: Column | str, text: Column | str) -> Column:
    """1 to 6, null for what is no heading: by style name, else by a numbered capital start under 120 characters."""
    number = F.regexp_extract(col(style), r"(\d+)", 1).try_cast("int")
    numbered = (F.length(col(text)) < 120) & col(text).rlike(r"^\d+(\.\d+)*\s+[А-ЯA-ZЁ]")
    dots = F.length(F.regexp_replace(F.regexp_extract(col(text), r"^([\d.]+)", 1), r"[^.]", ""))
    return F.when(F.coalesce(F.startswith(col(style), F.lit("Heading")), F.lit(False)), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(number, F.lit(1))))).when(numbered, F.least(F.lit(6), dots + 1))


def table_rows(rows: Column | str) -> Column:
    """array<array<string>> as lines `| a | b |`."""
    cell = lambda c: single_spaces(strip(F.coalesce(c, F.lit(""))))
    return F.array_join(F.transform(col(rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n")


def section_label(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(col(path), F.lit(-1)), F.lit("Введение"))


def with_section(text: Column | str, path: Column | str) -> Column:
    head = F.array_join(col(path), "\n")
    return F.when((F.size(col(path)) < 1) | F.startswith(col(text), head), col(text)).otherwise(F.concat(head, F.lit("\n\n"), col(text)))


def document_year(filename: Column | str, text: Column | str, default: int = 2024) -> Column:
    year = lambda c: F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(20\d{2})", 1).try_cast("int")
    return F.coalesce(year(filename), year(text), F.lit(default))


def document_code(filename: Column | str, text: Column | str) -> Column:
    """The prefix is a class of letters, as in the documents that this pattern was made for."""
    pattern = r"([ОИПТСНД|]+[\s\-–—]*\d+[\s\-–—]+\d{4})"
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, 1), F.lit(""))
    return normalize_code(F.coalesce(found(filename), found(text)))


# Words that tell a document's geography.
RU_WORDS = ["россия", "кольский", "гмк", "комсомольский", "кайерканский", "норильск", "сибирь", "урал", "черняевск"]
GLOBAL_WORDS = ["australia", "caledonia", "chile", "harbour", "glencore", "eramet", "outotec", "valegoro"]


def hits(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def guess_geography(text: Column | str, filename: Column | str | None = None, ru: list[str] = RU_WORDS, abroad: list[str] = GLOBAL_WORDS) -> Column:
    both = F.lower(F.concat_ws(" ", col(text), F.lit("") if filename is None else col(filename)))
    a, b = hits(both, ru), hits(both, abroad)
    return F.when(a > b, "RU").when(b > a, "Global").when(both.rlike("[а-я]"), "RU").otherwise("Global")


# Fixed value: what makes a text sensitive.
SENSITIVE = rf"(?iu){NOT_AFTER}(U|Pu|UF6|уран|плутоний|plutonium|uranium){NOT_BEFORE}"


def is_sensitive(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(SENSITIVE), F.lit(False))


# What tells slides and titles from text with a domain.
BOILERPLATE = r"(?iu)^(цель\s+курса|результат\s+обучения|результаты\s+обучения|содержание|оглавление|спасибо(?:\s+за\s+внимание)?|вопросы\??|контакты|thank\s+you|agenda|overview|summary)\s*\.?$"
DOMAIN = r"(?iu)(никел|медь|медн|шлак|штейн|выщелач|электроэкстрак|плавк|фильтр|сульфат|хлорид|катод|анод|руда|электролит|pH|°C|мг/л|мг/дм|А/м|температур|концентрац|процесс|печь|ванн|оборуд|материал|раствор|металл|прочност|извлечен|гидрометалл|пирометалл|nickel|copper|electrowinning|leaching|electrolyte|slag|smelting|furnace|ore|anode|cathode|filter)"
NUMBER_UNIT = r"(?iu)(?:\d+([.,]\d+)?\s*(°C|К|мг/л|мг/дм³|г/л|%|МПа|HB|А/м|pH))|(?:pH\s*[:=]?\s*\d+([.,]\d+)?)"


def low_signal_reason(text: Column | str, shortest: int = 50) -> Column:
    """Why a chunk is skipped, null if it isn't; the first rule that holds counts."""

    def reason(body: Column, lines: Column, kept: Column) -> Column:
        return (
            F.when(F.length(body) < shortest, "too_short")
            .when(kept.rlike(r"(?U)\A[\d.,\s\-–—]+\z"), "slide_number")
            .when(F.regexp_count(kept, F.lit("[A-Za-zА-Яа-яЁё0-9]{2,}")) < 4, "too_few_tokens")
            .when((F.size(lines) <= 2) & F.exists(lines, lambda x: x.rlike(BOILERPLATE)), "presentation_boilerplate")
            .when((F.length(kept) < 180) & ~kept.rlike(DOMAIN) & ~kept.rlike(NUMBER_UNIT), "low_domain_signal")
        )

    def split(body: Column) -> Column:
        lines = F.filter(F.transform(F.split(body, r"\r?\n"), strip), lambda x: F.length(x) > 2)
        return bound(lines, lambda own: bound(F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise(body), lambda kept: reason(body, own, kept)))

    return bound(strip(F.coalesce(col(text), F.lit(""))), split)


def experiment_id(code: Column, slug_: Column, version: Column, index: Column, default_version: str = "cn_v1") -> Column:
    return F.format_string("EXP-%s-%s-%02d", F.coalesce(F.nullif(code, F.lit("")), slug_), F.coalesce(F.nullif(version, F.lit("")), F.lit(default_version)), index)


# Words that make an entity an output.
OUTPUT_MATERIALS = ["катод", "осадок", "раствор ni-cu", "шлам", "хвосты", "продукт", "выход"]
OUTPUT_PROPERTIES = ["выход по току", "светлость", "извлечение", "чистота", "содержание", "дефект", "производительность"]


def entity_role(kind: Column | str, value: Column | str, materials: list[str] = OUTPUT_MATERIALS, properties: list[str] = OUTPUT_PROPERTIES) -> Column:
    """input, process or output; null for a blank value."""
    low, kind = F.lower(strip(value)), col(kind)
    return (
        F.when(low == "", None)
        .when(kind.isin("Process", "Equipment"), "process")
        .when(kind.isin("Material", "Facility") & (hits(low, materials) > 0), "output")
        .when((kind == "Property") & (hits(low, properties) > 0), "output")
        .otherwise("input")
    )


# Numbers with units.
UNITS = r"(?:мг/л|мг/дм³|г/л|%|МПа|HB)"
ENRICHMENT = [
    rf"(?iu){NOT_AFTER}(\d+[-–]\d+\s*°C|\d+\s*°C|\d+\s*К){NOT_BEFORE}",
    rf"(?iu){NOT_AFTER}(pH\s*[:=]?\s*\d+(?:[.,]\d+)?){NOT_BEFORE}",
    rf"(?iu){NOT_AFTER}(\d+[-–]\d+\s*А/м[²2]|\d+\s*А/м[²2]){NOT_BEFORE}",
    rf"(?iu){NOT_AFTER}(\d+(?:[.,]\d+)?\s*{UNITS}){NOT_BEFORE}",
    rf"(?iu)((?:[<>]|≤|≥)\s*\d+(?:[.,]\d+)?\s*{UNITS}){NOT_BEFORE}",
]


def numeric_mentions(text: Column | str) -> Column:
    """array<string>: numbers with units, in the patterns' order, the first of each lower-cased form."""
    every = F.concat(*(F.transform(F.regexp_extract_all(col(text), F.lit(p), F.lit(1)), strip) for p in ENRICHMENT))

    def first(own: Column) -> Column:
        return bound(F.transform(own, F.lower), lambda low: F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    return bound(every, first)


def repair_json(text: Column | str) -> Column:
    """The JSON object of a model's answer: without fences, byte order mark, curly quotes and trailing commas."""
    clean = F.translate(F.regexp_replace(col(text), "﻿", ""), "“”„«»", '"""""')
    clean = F.regexp_replace(clean, r"```(?:json)?", "")
    inner = F.regexp_extract(clean, r"(\{[\s\S]*\})", 1)
    return F.regexp_replace(F.when(inner == "", clean).otherwise(inner), r",\s*([}\]])", "$1")


def joined_content(parts: Column | str) -> Column:
    """A model's answer that comes in parts (type, text): the texts of those that are text, in order."""
    own = F.filter(col(parts), lambda p: F.coalesce(p["type"] == "text", F.lit(True)) & p["text"].isNotNull())
    return F.array_join(F.transform(own, lambda p: p["text"]), "")


def fenced(text: Column | str) -> Column:
    """What stands in a model's first fence; null if there is none."""
    return F.nullif(F.regexp_extract(col(text), r"```(?:json)?\s*([\s\S]*?)\s*```", 1), F.lit(""))


def json_object(text: Column | str) -> Column:
    """The first candidate of an answer that is a JSON object: what its fence holds, else its outermost braces."""
    is_object = lambda c: bound(F.get_json_object(repair_json(c), "$"), lambda root: F.when(root.startswith("{"), root))
    return F.coalesce(is_object(fenced(text)), is_object(text))


def json_root(text: Column | str) -> Column:
    """The JSON that an answer holds: its object, else whatever its repaired text is; null where that is no JSON."""
    return F.coalesce(json_object(text), F.get_json_object(repair_json(text), "$"))


def relation_type(name: Column | str) -> Column:
    """One of RELATION_TYPES, null if it is none and no alias of one."""
    clean = F.translate(F.lower(strip(name)), " -", "__")
    pairs = [F.lit(x) for pair in schema.RELATION_ALIASES.items() for x in pair]
    mapped = F.coalesce(F.try_element_at(F.create_map(*pairs), clean), clean)
    return F.when(mapped.isin(schema.RELATION_TYPES), mapped)


def graph_relation(name: Column | str) -> Column:
    return F.replace(F.upper(col(name)), F.lit(" "), F.lit("_"))


def entity_type(name: Column | str) -> Column:
    """The known type that this name means whatever its case, else null."""
    pairs = [F.lit(x) for t in schema.ENTITY_TYPES for x in (t.lower(), t)]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(name)))


def contains_term(text: Column, term: Column) -> Column:
    """As a substring, or without the last two letters if it has more than four."""
    t = F.lower(term)
    return F.contains(text, t) | ((F.length(t) > 4) & F.contains(text, F.left(t, F.length(t) - 2)))


def matches_value(query: Column, value: Column) -> Column:
    """contains_term, or every word of three letters or more of a value of several words."""
    words = F.split(value, " ")
    long = F.filter(words, lambda w: F.length(w) >= 3)
    every = (F.size(words) > 1) & (F.size(long) > 0) & F.forall(long, lambda w: contains_term(query, w))
    return (value != "") & (contains_term(query, value) | every)


def query_properties(text: Column | str) -> Column:
    """array<string> of the properties that a question names."""
    low = F.lower(col(text))
    found = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    ph = F.upper(found(rf"(?U){NOT_AFTER}(ph\s*[:=<>≤≥]?\s*\d+([.,]\d+)?){NOT_BEFORE}"))
    temperature = F.concat(F.lit("Температура: "), F.upper(found(rf"(?U){NOT_AFTER}(\d+\s*°c){NOT_BEFORE}")))
    density = F.concat(F.lit("плотность тока: "), F.upper(found(rf"(?U){NOT_AFTER}(\d+\s*а/м2){NOT_BEFORE}")))
    return F.filter(F.array(ph, temperature, density), lambda x: x.isNotNull())


# The emergency vocabulary, (word to look for, type, value).
VOCABULARY = [
    *((w, "Material", w) for w in ("никель", "медь", "электролит", "раствор", "руда", "шлак", "кобальт", "шлам", "штейн")),
    ("медн", "Material", "медь"),
    ("меди", "Material", "медь"),
    ("электроэкстракция", "Process", "электроэкстракция"),
    ("выщелачивание", "Process", "кучное выщелачивание"),
    ("обессоливание", "Process", "обессоливание"),
    ("кольская", "Facility", "кольская гмк"),
    ("long harbour", "Facility", "завод long harbour"),
    ("кайеркан", "Facility", "рудник кайерканский"),
]


def source_family(id_: Column | str) -> Column:
    return F.when(F.size(F.split(col(id_), "-")) >= 3, F.substring_index(col(id_), "-", 3)).otherwise(col(id_))


def raw_noise(id_: Column | str) -> Column:
    up = F.upper(F.coalesce(col(id_), F.lit("")))
    return F.startswith(up, F.lit("EXP-RAW")) | F.array_contains(F.slice(F.split(up, "-"), 1, 2), "RAW")


# What is redacted.
SECRET_PATTERNS = [r"sk-[A-Za-z0-9]{20,}", r"(?i)api[_-]?key", r"(?i)Bearer\s+[A-Za-z0-9._-]+"]


def redact(text: Column | str, mark: str = "[REDACTED]") -> Column:
    out = col(text)
    for p in SECRET_PATTERNS:
        out = F.regexp_replace(out, p, mark.replace("$", r"\$"))
    return out


def keyword_in_answer(answer: Column, keyword: Column) -> Column:
    """The keyword, or a beginning of it that lacks at most five letters and has five at least."""
    a, w = normalize_value(answer), normalize_value(keyword)
    least = F.greatest(F.lit(5), F.length(w) - 5)
    return F.contains(a, w) | ((F.length(w) >= least) & F.contains(a, F.left(w, least)))


# Words that tell an ontology label's type, looked for in this order.
LABEL_WORDS = {
    "Process": ["процесс", "выщелачивание", "плавка", "extraction", "leaching", "smelting", "flotation", "electrowinning"],
    "Equipment": ["печь", "мельница", "ванна", "furnace", "mill", "bath", "cell", "autoclave"],
    "Facility": ["рудник", "завод", "гмк", "mine", "plant", "harbour", "facility"],
}


def label_type(label: Column | str, words: dict[str, list[str]] = LABEL_WORDS) -> Column:
    tokens = F.regexp_extract_all(F.lower(col(label)), F.lit("[a-zа-яё0-9]+"), F.lit(0))
    out = F.lit("Material")
    for kind, own in reversed(words.items()):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, own))), kind).otherwise(out)
    return out


def split_output(value: Column | str) -> Column:
    """struct(name, value) of `name: value`, null without a colon."""
    parts = F.split(col(value), ":", 2)
    return F.when(F.size(parts) == 2, F.struct(strip(parts[0]).alias("name"), strip(parts[1]).alias("value")))


NUMBER = r"([-+]?\d*\.\d+|\b[-+]?\d+\b)"


def first_number(value: Column | str) -> Column:
    return F.regexp_extract(col(value), NUMBER, 1).try_cast("double")


def number_label(value: Column | str) -> Column:
    """The property's text without its number and separators."""
    return F.regexp_replace(F.regexp_replace(F.replace(col(value), F.regexp_extract(col(value), NUMBER, 1), F.lit("")), r"[:=\d.,\s]+", " "), r"^ +| +$", "")


def preview(text: Column | str, longest: int = 240) -> Column:
    flat = F.regexp_replace(strip(text), r"\s*\n\s*", " ")
    return F.when(F.length(flat) > longest, F.concat(F.left(flat, F.lit(longest)), F.lit("..."))).otherwise(flat)


# Fixed value: how a model refuses.
REFUSALS = r"(?iu)я\s+не\s+могу\s+обсуждать|can't\s+discuss|cannot\s+discuss"


def is_refusal(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(REFUSALS), F.lit(False))


def parse_pairs(text: Column | str) -> Column:
    """`Type:Value,Value` as an array of entities; a part without colon is a Property."""
    parts = F.filter(F.transform(F.split(col(text), ","), strip), lambda x: x != "")
    return F.transform(parts, lambda p: F.when(F.contains(p, F.lit(":")), F.struct(strip(F.substring_index(p, ":", 1)).alias("type"), strip(F.regexp_replace(p, r"^[^:]*:", "")).alias("value"))).otherwise(F.struct(F.lit("Property").alias("type"), p.alias("value"))))
