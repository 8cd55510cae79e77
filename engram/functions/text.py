"""Text rules as column expressions: normal forms, question checks, lexicon dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and term lists that results depend on.
TOKEN = r"[a-zA-Z0-9]+|[一-鿿]"
META_TERMS = r"(?iU)\b(route|evidence|facts?|nodes?|memory|context|ids?|instructions?)\b"
COMPARISON_DIMENSIONS = {
    "cost": ["price", "cost", "budget", "paid", "purchase", "$", "价格", "费用", "预算"],
    "time": ["time", "date", "duration", "schedule", "frequency", "routine", "时间", "日期", "时长", "频率"],
    "quantity": ["count", "number", "amount", "quantity", "distance", "数量", "次数", "距离"],
    "preference": ["prefer", "favorite", "choice", "satisfaction", "like", "偏好", "喜欢", "选择"],
    "location": ["location", "place", "venue", "city", "travel", "地点", "场所", "城市"],
    "physical_attribute": ["age", "size", "weight", "height", "length", "年龄", "尺寸", "重量", "长度"],
}
STATE_TERMS = [" plan ", " goal ", " decision ", " status ", " habit ", " job ", " relationship ", "计划", "目标", "决定", "状态", "习惯"]
TRANSITION_TERMS = [
    " no longer ", " used to ", " changed ", " switched ", " replaced ", " instead ", " started ", " stopped ", " increased ",
    " decreased ", " moved ", " became ", " finished ", " completed ", " graduated ", " quit ", " now ", " currently ",
    "不再", "改为", "换成", "开始", "停止", "增加", "减少", "完成", "毕业", "离职", "现在", "目前",
]


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def fold(c: Column) -> Column:
    """Case-folded; of the folds that lower() lacks, sharp s only."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words and single CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def document_text(content: Column, tags: Column) -> Column:
    return F.concat_ws(" ", content, tags)


def normal_question(c: Column) -> Column:
    """Folded, without closing marks, white space runs as one space."""
    return strip(F.regexp_replace(F.regexp_replace(fold(c), r"[?.!？。！]+\z", ""), r"(?U)\s+", " "))


def plain(c: Column) -> Column:
    """Folded words with single spaces, anything else dropped."""
    return F.trim(F.regexp_replace(fold(c), r"(?U)\W+", " "))


def has_question_mark(c: Column) -> Column:
    return c.rlike(r"[?？]\z")


def with_question_mark(c: Column) -> Column:
    return F.when(has_question_mark(c), c).otherwise(F.concat(F.regexp_replace(c, r"[.!。！]+\z", ""), F.lit("?")))


def question_error(question: Column, identifiers: Column) -> Column:
    """The first rule that a question breaks, or null."""
    marks = F.regexp_count(question, F.lit("[?？]"))
    leaks = F.exists(F.coalesce(identifiers, F.array().cast("array<string>")), lambda i: F.contains(fold(question), fold(i)))
    return (
        F.when(F.coalesce(question, F.lit("")) == "", "question_invalid")
        .when(marks > 1, "multiple_questions")
        .when(question.rlike(META_TERMS), "metadata_leak")
        .when(leaks, "id_leak")
    )


def is_abstention(answer: Column) -> Column:
    return F.upper(F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"[.!]+\z", "")) == "INSUFFICIENT_INFORMATION"


def leaks_answer(question: Column, answer: Column) -> Column:
    """Whether the answer's words stand in the question."""
    a = plain(F.coalesce(answer, F.lit("")))
    return (a != "") & F.contains(F.concat(F.lit(" "), plain(question), F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))


def without_think(c: Column) -> Column:
    """Without an empty think marker in front."""
    return strip(F.regexp_replace(c, r"(?sU)\A\s*<think>\s*</think>\s*", ""))


def parsed_question(c: Column) -> Column:
    """A one-line question, else null."""
    q = without_think(c)
    return F.when((q != "") & ~q.rlike(r"[\r\n]"), q)


def node_text(key: Column, memory: Column, tags: Column) -> Column:
    some = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return fold(F.concat_ws(" ", F.nullif(key, F.lit("")), F.nullif(memory, F.lit("")), some))


def _bounded(terms: list[str]) -> str:
    """A pattern of any of the terms: words are bounded, all in one group, so that bounds are looked for once at each place."""
    escaped = {t: "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in t) for t in terms}
    words = [e for t, e in escaped.items() if t.isascii() and t != "$"]
    return "(?U)" + "|".join([rf"\b(?:{'|'.join(words)})\b", *(e for e in escaped.values() if e not in words)])


def comparison_dimensions(text: Column) -> Column:
    """Names of the lexicons with a term in the text.  Patterns, which are slow, judge only texts that hold a term's letters."""
    found = [F.when(has_any(text, terms) & text.rlike(_bounded(terms)), F.lit(name)) for name, terms in COMPARISON_DIMENSIONS.items()]
    return F.filter(F.array(*found), lambda d: d.isNotNull())


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the terms.  They are a list that is walked over: an OR of dozens makes a method too long
    for the JVM to compile."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def temporal_dimension(target_text: Column, source_tags: Column, target_tags: Column) -> Column:
    """The dimension in which the target changed: the shortest shared tag, 'state' if it names one, else null."""
    padded = F.concat(F.lit(" "), target_text, F.lit(" "))
    return F.when(has_any(padded, TRANSITION_TERMS), change_dimension(has_any(padded, STATE_TERMS), source_tags, target_tags))


def change_dimension(state: Column, source_tags: Column, target_tags: Column) -> Column:
    """``temporal_dimension`` of a target that shows a change; ``state``: whether it shows a state."""
    folded = lambda tags: F.transform(F.coalesce(tags, F.array().cast("array<string>")), fold)
    shared = F.array_min(F.transform(F.array_intersect(folded(source_tags), folded(target_tags)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return F.coalesce(shared, F.when(state, F.lit("state")))


def short_hash(*parts: Column, sep: str = "|") -> Column:
    """The first 20 hex digits of the parts' SHA-256; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 20)


def iso_time(c: Column) -> Column:
    """An ISO time as a timestamp, UTC where it names no zone (with the session's zone set so); null if it isn't one."""
    return F.when(strip(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(strip(c)))


def latest_time(times: Column) -> Column:
    """The last of several ISO times; null if none is one."""
    return F.array_max(F.transform(times, iso_time))
