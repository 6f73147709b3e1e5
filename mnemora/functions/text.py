"""Text functions, Column to Column. No UDFs: all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

STRINGS = "array<string>"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast(STRINGS) if values else F.array().cast(STRINGS)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words between white space (Unicode's included); null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), "")


def spaced(text: Column) -> Column:
    """The :func:`words` of a text with one space between them; the pattern is compiled once, not for every row."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def _stripped(text: Column, punctuation: str, shortest: int) -> Column:
    """Words as a set, without punctuation at their ends and without those shorter than ``shortest``.

    Two expressions over the whole text in place of a lambda per word: they stay in generated code.
    """
    marks = "".join(f"\\{c}" for c in punctuation)
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U)(?<!\S)[{marks}]+|[{marks}]+(?!\S)", "")
    return F.split(F.regexp_replace(bare, rf"(?U)(?<!\S)\S{{1,{shortest - 1}}}(?!\S)", ""), r"(?U)\s+")


def tokens(text: Column, strict_bytes: bool = False) -> Column:
    """Content words as a set: stripped of punctuation, three characters and more, no stop words.

    ``strict_bytes`` measures length in bytes.
    """
    dropped = _strings(["", *vocab.STOP_WORDS])
    if strict_bytes:
        stripped = F.transform(words(text), lambda w: F.btrim(w, F.lit(vocab.PUNCTUATION)))
        return F.array_except(F.filter(stripped, lambda w: F.octet_length(w) > 2), dropped)
    return F.array_except(_stripped(text, vocab.PUNCTUATION, 3), dropped)


def token_hashes(text: Column) -> Column:
    """:func:`tokens` as 64-bit hashes, with one pattern for the whole text; short words and stop words go by hash."""
    marks = "".join(f"\\{c}" for c in vocab.PUNCTUATION)
    between = rf"(?U)(?=[{marks}\s])(?:^[{marks}]+|[{marks}]*(?:\s+[{marks}]*)+|[{marks}]+\z)"  # the look ahead passes letters at once
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), between)
    hashes = F.transform(found, lambda w: F.when(F.length(w) > 2, F.xxhash64(w)))
    return F.array_except(hashes, F.array(F.lit(None).cast("bigint"), *(F.xxhash64(F.lit(w)) for w in vocab.STOP_WORDS)))


def short_tokens(text: Column) -> Column:
    """Content words of the expansion step: another stop list, dashes and slashes stripped as well."""
    return F.array_except(_stripped(text, vocab.SHORT_PUNCTUATION, 3), _strings(["", *vocab.SHORT_STOP_WORDS]))


def plain_tokens(text: Column) -> Column:
    """Words as a set, punctuation and stop words kept: what ranked recall compares."""
    return F.array_distinct(words(text))


def query_tokens(query: str, kind: str = "content") -> Column:
    """The tokens of a literal query as a constant: ``content``, ``short`` or ``plain``, by the rules above."""
    found = query.lower().split()
    if kind != "plain":
        marks, stop = (vocab.PUNCTUATION, vocab.STOP_WORDS) if kind == "content" else (vocab.SHORT_PUNCTUATION, vocab.SHORT_STOP_WORDS)
        found = [w for w in (w.strip(marks) for w in found) if len(w) > 2 and w not in stop]
    return _strings(list(dict.fromkeys(found)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members of two sets; 0 where either is empty or null."""

    def share(s: Column) -> Column:
        return F.when((s["a"] > 0) & (s["b"] > 0), s["n"] / (s["a"] + s["b"] - s["n"])).otherwise(F.lit(0.0))

    counted = lambda s: F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), F.size(F.array_intersect(s["a"], s["b"])).alias("n"))
    return bound(bound(F.struct(a.alias("a"), b.alias("b")), counted), share)


def tag_set(tags: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(tags, F.array().cast(STRINGS)), lambda t: F.trim(F.lower(t))))


def composite(word: Column, tag: Column, concept: Column) -> Column:
    w, t, c = vocab.SIMILARITY_WEIGHTS
    return word * w + tag * t + concept * c


def similarity(content_a: Column, concept_a: Column, tags_a: Column, content_b: Column, concept_b: Column, tags_b: Column) -> Column:
    """Weighted similarity of content words, tags and concept words."""
    return composite(
        jaccard(tokens(content_a), tokens(content_b)), jaccard(tag_set(tags_a), tag_set(tags_b)), jaccard(tokens(concept_a), tokens(concept_b))
    )


def numbers(text: Column) -> Column:
    """The numbers in a text, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(vocab.NUMBER_PATTERN), 0))


def _single(a: Column, b: Column) -> Column:
    return (F.size(a) == 1) & (F.size(b) == 1)


def numbers_conflict(a: Column, b: Column) -> Column:
    """True if each of two sets of numbers has one that the other lacks; for one number each without building sets."""
    other = (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)
    return F.when(_single(a, b), F.get(a, F.lit(0)) != F.get(b, F.lit(0))).otherwise(other)


def conflict_text(a: Column, b: Column) -> Column:
    """``"a, b vs c"``: the numbers that only one of two sets in conflict has."""
    only = lambda x, y: F.array_join(F.when(_single(x, y), x).otherwise(F.sort_array(F.array_except(x, y))), ", ")
    return F.concat(only(a, b), F.lit(" vs "), only(b, a))


def conflicting_numbers(numbers_a: Column, numbers_b: Column, concept_a: Column, concept_b: Column) -> Column:
    """``"a, b vs c"``: numbers that only one of two facts on a shared concept has; null if there is none."""
    common = F.filter(F.array_intersect(words(concept_a), words(concept_b)), lambda w: F.length(w) > 2)
    return F.when((F.size(common) > 0) & numbers_conflict(numbers_a, numbers_b), conflict_text(numbers_a, numbers_b))


def numeric_contradiction(content_a: Column, content_b: Column, concept_a: Column, concept_b: Column) -> Column:
    """:func:`conflicting_numbers` of two texts."""
    return conflicting_numbers(numbers(content_a), numbers(content_b), concept_a, concept_b)


def negation_contradiction(a: Column, b: Column) -> Column:
    """True if two texts share two words and exactly one of them negates."""
    left, right, no = plain_tokens(a), plain_tokens(b), _strings(vocab.NEGATION_WORDS)
    shared = F.size(F.array_except(F.array_intersect(left, right), no))
    return (shared >= 2) & (F.arrays_overlap(left, no) != F.arrays_overlap(right, no))


def entity_name(content: Column, concept: Column) -> Column:
    """The main proper name, lower case: the longest in the concept, else in the content; null if none.

    Without a name of several parts, the first capitalised word that doesn't open the text.
    """

    def of(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        names = F.regexp_extract_all(text, F.lit(vocab.NAME_PATTERN), 1)
        longest = F.aggregate(names, F.lit(""), lambda best, n: F.when(F.length(n) > F.length(best), n).otherwise(best))
        spaced = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
        later = F.filter(F.slice(spaced, 2, F.greatest(F.size(spaced), F.lit(1))), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 2))
        single = F.get(F.filter(F.transform(later, lambda w: F.btrim(w, F.lit(vocab.PUNCTUATION))), lambda w: w.rlike(r"^\p{Lu}")), F.lit(0))
        return F.lower(F.when(longest != "", longest).otherwise(single))

    return F.coalesce(of(concept), of(content))


def memory_category(content: Column, concept: Column) -> Column:
    """procedural, prospective, episodic or semantic, by the first list with a word in the text."""
    text = F.lower(F.concat_ws(" ", F.coalesce(content, F.lit("")), F.coalesce(concept, F.lit(""))))
    named = lambda ws: F.exists(_strings(ws), lambda w: F.contains(text, w))
    return F.when(named(vocab.PROCEDURAL_WORDS), "procedural").when(
        named(vocab.PROSPECTIVE_WORDS), "prospective"
    ).when(named(vocab.EPISODIC_WORDS), "episodic").otherwise("semantic")


def content_hash(concept: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(concept, F.lit("")), F.lit("\x1f"), F.coalesce(content, F.lit(""))), 256)


def node_hash(node_type: Column, properties: Column) -> Column:
    """Sixteen hex digits over a node's type and its properties in order of their names."""
    pairs = F.transform(
        F.array_sort(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>")))),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    )
    return F.substring(F.sha2(F.concat_ws("|", node_type, pairs), 256), 1, 16)


def experience_id(context: Column, outcome: Column, timestamp: Column) -> Column:
    """``exp_<date>_<time>_<16 hex digits>`` over both texts and the UTC time."""
    stamp = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(
        F.lit("exp_"), F.date_format(timestamp, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha2(F.concat(context, outcome, stamp), 256), 1, 16)
    )


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def distilled_facts(text: Column) -> Column:
    """Clauses of a text that say something: an array in order, repeats included.

    Sentences end at runs of ``.!?`` before white space or the end. They split at a separator only
    where both sides keep three words; white space is collapsed, outer punctuation stripped, and what has
    fewer than three words dropped.
    """
    sentences = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])(?=\s|$)")
    empty = F.array().cast(STRINGS)

    def clauses(clause: Column, separator: str) -> Column:
        parts = F.split(clause, rf"\Q{separator}\E", -1)
        start = F.struct(empty.alias("done"), F.get(parts, F.lit(0)).alias("open"))

        def add(state: Column, part: Column) -> Column:
            apart = (_word_count(state["open"]) >= vocab.MIN_CLAUSE_WORDS) & (_word_count(part) >= vocab.MIN_CLAUSE_WORDS)
            return F.when(apart, F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), part.alias("open"))).otherwise(
                F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit(separator), part).alias("open"))
            )

        rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
        return F.aggregate(rest, start, add, lambda s: F.concat(s["done"], F.array(s["open"])))

    def every(texts: Column, separator: str) -> Column:
        return F.flatten(F.transform(texts, lambda c: clauses(c, separator)))

    split = sentences
    for separator in vocab.CLAUSE_SEPARATORS:
        split = every(split, separator)
    return F.filter(F.transform(split, normalised_fact), lambda f: f.isNotNull())


def normalised_fact(text: Column) -> Column:
    """A text with white space collapsed and outer punctuation stripped; null under three words."""
    collapsed = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), " ")
    trimmed = F.btrim(collapsed, F.lit(" .,;:!?"))
    return F.when(_word_count(trimmed) >= vocab.MIN_FACT_WORDS, trimmed)


def pattern_key(kind: Column, link_type: Column, file: Column) -> Column:
    """What discoveries are grouped by: type and link type, or prefix of a Markdown file and type."""
    kind = F.coalesce(kind, F.lit("unknown"))
    prefix = F.when(F.contains(file, F.lit("_")), F.split_part(file, F.lit("_"), F.lit(1))).otherwise(F.regexp_replace(file, r"\.md$", ""))
    return F.when(
        link_type.isNotNull(), F.concat(kind, F.lit("_"), link_type)
    ).when(file.endswith(".md"), F.concat(prefix, F.lit("_"), kind)).otherwise(kind)


def scrub(text: Column) -> Column:
    """The text with every credential replaced."""
    for pattern in vocab.CREDENTIALS:
        text = F.regexp_replace(text, pattern, vocab.REDACTED)
    return text


def has_credentials(text: Column) -> Column:
    """True if some pattern matches. One alternation: a single pass over the text."""
    found = F.lit(False)
    for pattern in vocab.CREDENTIALS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def query_cost(sql: Column) -> Column:
    hit = lambda pattern, points: F.when(sql.rlike(pattern), points).otherwise(0)
    joins = F.regexp_count(sql, F.lit(r"(?i)\bJOIN\b")) * vocab.COST_JOIN
    unlimited = F.when(sql.rlike(r"(?i)SELECT") & ~sql.rlike(r"(?i)\bLIMIT\b"), vocab.COST_NO_LIMIT).otherwise(0)
    return vocab.COST_BASE + hit(
        r"(?i)SELECT\s+\*\s+FROM\s+\w+", vocab.COST_SCAN
    ) + joins + hit(r"(?is)SELECT.*\(.*SELECT", vocab.COST_SUBQUERY) + hit(r"(?i)\bORDER BY\b", vocab.COST_SORT) + unlimited


def safe_query(sql: Column) -> Column:
    """A single SELECT without comments' help: no second statement, denied word or catalogue table."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "))
    denied = bare.rlike(rf"(?i)\b(?:{'|'.join(vocab.DENIED_SQL)})\b") | bare.rlike(r"(?i)\bsqlite_(?:temp_)?master\b")
    return F.coalesce(bare.rlike(r"(?i)^select") & ~F.contains(bare, F.lit(";")) & ~denied, F.lit(False))


def safe_cypher(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?i)^match") & ~text.rlike(rf"(?i)\b(?:{'|'.join(vocab.DENIED_CYPHER)})\b"), F.lit(False))
