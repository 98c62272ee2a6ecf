"""Query-text expressions: Column in, Column out.

Patterns carry ``(?U)`` where letters and spaces of every script count, and ``(?d)`` where a dot
stops at a newline only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quercus.fixed_values import (
    BANNED_WORDS,
    BASIC_INSTRUCTION,
    ELABORATE_INSTRUCTION,
    EMPTY_QUERY_TEXT,
    FEW_SHOT_INSTRUCTION,
    FEW_SHOT_LEAD,
    MODEL_TEMPLATES,
    NO_MATCH_STATUS,
    PREFIXES,
    SYSTEM_BLOCK,
)

# Patterns.
BLANK = r"(?U)\A[\s\x1c-\x1f]*\z"
EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
COUNT_CALL = r"(?U)(?:COUNT) ?\((?:DISTINCT)? ?\(?(?:\??\w*|\*?)\)?\)"
COUNT_CALL_TWO_CASES = r"(?U)(?:COUNT|count) ?\((?:DISTINCT|distinct)? ?\(?(?:\??\w*|\*?)\)?\)"
LIMIT_CLAUSE = r"(?U)\s+LIMIT\s+\d+(?=\s|$)"
ITEM_ID = r"(?U):(Q\d+|P\d+|L\d+)"
ITEM_ID_OR_REST = r"(?Us)(:[QPL]\d+|.+?(?=:[QPL]\d|\z))"
PLACEHOLDER = "(?U)\\[%s:([\\w\\s,:;'`\".!?]+)\\]"
QUOTED_CAPITAL = r'(?d)"[A-Z].*"'
COMMENT = r"(?d)#.*"
TERM = r"\??[\w:/*\[\]]*"
SINGLE_HOP = r"(?U)WHERE\s?\{[\s\S]" + TERM + " " + TERM + " " + TERM + r"\s*\}"
MARKUP = r"(?dU)</?[a-zA-z?;=\"' ]*>|<.+[\W]>"
MARKUP_ATTRIBUTE = r'(?d)(?:class|colspan|style|rowspan)=".+"'
URL = r"https:[a-zA-Z%:./#_0-9]+"
PREFIX_LINE = r"(?dU)PREFIX \w+:.*\n"
TOKEN = r"(?U)\w+|[^\w\s]"
SENTENCE_END = r"(?U)([.!?])\s+"
STORED_ANSWER = r"(?U)err.sparql='([\w\s\d\[\]/<>:,.\"#\\?{};()\-*]*)'"
AFTER_INSTRUCTION = r"(?d)\[/INST\] (.*)"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


# ---- prefixes and LIMIT -------------------------------------------------------------------------


def add_prefixes(query: Column) -> Column:
    """Put a PREFIX line in front for each known prefix that is used and not declared.

    One regex pass collects the used names; the few that are known are looked up and put in table
    order. A row without any name is passed through.
    """
    known = F.create_map(
        *[
            part
            for at, (name, iri) in enumerate(PREFIXES.items())
            for part in (F.lit(name), F.struct(F.lit(at).alias("at"), F.lit(f"PREFIX {name}: <{iri}>\n").alias("line")))
        ]
    )
    used = F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?U)(?<=\W)(\w+):"), 1))
    found = F.transform(used, lambda name: F.try_element_at(known, name))
    wanted = F.filter(
        found, lambda p: p.isNotNull() & ~F.contains(query, F.rtrim(p["line"], F.lit("\n")))
    )
    header = F.array_join(F.transform(F.array_sort(wanted), lambda p: p["line"]), "")
    with_gap = F.regexp_replace(header, r"(?s)\A(.+)\z", "$1\n")
    return F.when(query.rlike(r"(?U)\W\w+:"), F.concat(with_gap, query)).otherwise(query)


def can_add_limit(query: Column) -> Column:
    upper = F.upper(query)
    return F.coalesce(~is_blank(query) & ~upper.rlike(COUNT_CALL) & ~upper.rlike(LIMIT_CLAUSE), F.lit(False))


def add_limit(query: Column, limit: int = 10) -> Column:
    if limit <= 0:
        return query
    return F.when(can_add_limit(query), F.concat(query, F.lit(f"\nLIMIT {limit}"))).otherwise(query)


def has_count_call(query: Column) -> Column:
    return query.rlike(COUNT_CALL_TWO_CASES)


# ---- cutting a query out of an answer -----------------------------------------------------------


def extract_tagged(text: Column, start: str, end: str) -> Column:
    """Text between the first start tag and the last end tag after it; null if either is missing."""
    begin = F.instr(text, start)
    rest = F.substr(text, begin + F.lit(len(start)))
    from_back = F.instr(F.reverse(rest), end[::-1])
    keep = F.length(rest) - from_back - F.lit(len(end) - 1)
    return F.when((begin > 0) & (from_back > 0), F.substr(rest, F.lit(1), keep))


def query_in_answer(text: Column, start: str, end: str) -> Column:
    """From the first PREFIX, else SELECT, after the start tag to the next end tag; null if absent."""
    begin = F.instr(text, start)
    rest = F.substr(text, begin)
    at = F.coalesce(F.nullif(F.instr(rest, "PREFIX"), F.lit(0)), F.instr(rest, "SELECT"))
    body = F.substr(rest, at)
    stop = F.instr(body, end)
    return F.when((begin > 0) & (at > 0) & (stop > 0), strip(F.substr(body, F.lit(1), stop - 1)))


def query_in_answer_status(text: Column, start: str, end: str) -> Column:
    return F.when(query_in_answer(text, start, end).isNull(), F.lit("NoSparqlMatch")).otherwise(F.lit(""))


def query_format_ok(text: Column, start: str, end: str) -> Column:
    inner = extract_tagged(text, start, end)
    return F.coalesce(~is_blank(inner) & inner.rlike(r"\A(?:PREFIX|SELECT|prefix|select)"), F.lit(False))


def prepare_query(text: Column, start: str, end: str, limit: int = 10, empty: str | None = EMPTY_QUERY_TEXT) -> Column:
    """Tagged text -> prefixes -> LIMIT: what would be executed."""
    return let(
        extract_tagged(text, start, end),
        lambda inner: F.when(is_blank(inner), F.lit(empty)).otherwise(
            let(add_prefixes(inner), lambda full: add_limit(full, limit))
        ),
    )


def unescape_tag(tag: Column) -> Column:
    return F.replace(tag, F.lit("\\n"), F.lit("\n"))


def recover_from_status(status: Column) -> Column:
    """Generated text kept inside a stored failure message, with its escapes undone."""
    stored = F.regexp_extract(status, STORED_ANSWER, 1)
    answer = F.nullif(F.regexp_extract(stored, AFTER_INSTRUCTION, 1), F.lit(""))
    plain = F.replace(answer, F.lit("\\\\"), F.lit("\x00"))
    for mark, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(mark), F.lit(char))
    return plain


# ---- ids, placeholders, templates ---------------------------------------------------------------


def extract_ids(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(ITEM_ID), 1)


def replace_ids(query: Column, replacement_of) -> Column:
    """Rewrite whole ids: the text is cut into ``:id`` pieces and what lies between, and each piece is
    looked up."""
    pieces = F.regexp_extract_all(query, F.lit(ITEM_ID_OR_REST), 1)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(replacement_of(p), p)), "")


def placeholders(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER % kind), 1)


def fill_placeholders(query: Column, linked_entities: Column, linked_properties: Column) -> Column:
    """Literal replacement, in list order, of ``[kind:label]`` by the linked id."""

    def fill(kind, start, linked):
        return F.aggregate(
            F.coalesce(linked, F.array().cast("array<struct<label:string,id:string,matched:string>>")),
            start,
            lambda text, x: F.replace(text, F.concat(F.lit(f"[{kind}:"), x["label"], F.lit("]")), x["id"]),
        )

    return fill("property", fill("entity", query, linked_entities), linked_properties)


def annotate_sentence(sentence: Column, entities: Column, properties: Column) -> Column:
    def mark(kind, start, items):
        numbered = F.transform(items, lambda v, i: F.struct(v.alias("v"), i.cast("string").alias("i")))
        return F.aggregate(
            numbered,
            start,
            lambda text, x: F.replace(text, x["v"], F.concat(F.lit(f"[{kind} "), x["i"], F.lit("]"))),
        )

    return mark("property", mark("entity", sentence, entities), properties)


def listing_part(text: Column, marker: str) -> tuple[Column, Column, Column, Column]:
    """Positions of the marker and of the brackets after it, and the items between them."""
    at = F.instr(text, marker)
    start = F.position(F.lit("["), text, F.greatest(at, F.lit(1)))
    end = F.position(F.lit("]"), text, F.greatest(at, F.lit(1)))
    raw = F.when(end > start, F.substr(text, start + 1, end - start - 1)).otherwise(F.lit(""))
    items = F.transform(F.split(raw, ","), lambda x: strip(x))
    return at, start, end, F.when((F.size(items) == 1) & (items[0] == ""), F.array().cast("array<string>")).otherwise(items)


def parse_entity_listing(text: Column) -> Column:
    """``Entities: [a, b] Properties: [c]`` -> struct(entities, properties, error)."""
    e_at, e_start, e_end, entities = listing_part(text, "ntities")
    p_at, p_start, p_end, properties = listing_part(text, "roperties")
    wrong_shape = (
        (e_at == 0) | (p_at == 0) | (e_start == 0) | (e_end == 0) | (p_start == 0) | (p_end == 0)
        | (p_start == e_start) | (e_end == p_end)
    )
    error = (
        F.when(text == "", F.lit("The generated answer by the LLM is empty."))
        .when(wrong_shape, F.lit("The format of the response is not correct."))
        .when((F.size(entities) == 0) & (F.size(properties) == 0), F.lit("Nothing has been extracted."))
    )
    return F.struct(
        F.when(error.isNull(), entities).alias("entities"),
        F.when(error.isNull(), properties).alias("properties"),
        error.alias("error"),
    )


def apply_template(template: Column, values: dict[str, Column], start: str = "", end: str = "") -> Column:
    """Replace ``{start}key{end}`` by its value, one key after the other."""
    if not isinstance(values, dict):
        raise TypeError("values must be a dictionary")
    text = template
    for key, value in values.items():
        if not isinstance(key, str):
            raise TypeError("all keys must be strings")
        text = F.replace(text, F.lit(f"{start}{key}{end}"), value.cast("string"))
    return text


def row_as_text(query: Column, description: Column, context: Column) -> Column:
    def shown(c):
        return F.coalesce(c, F.lit("None"))

    return F.concat(
        F.lit('QUERY="'), shown(query), F.lit('" DESCRIPTION="'), shown(description),
        F.lit('" CONTEXT="'), shown(context), F.lit('"'),
    )


def generation_prompt(
    query: Column, description: Column, context: Column, template: str, system_prompt: str, prompt: str, lead: str
) -> Column:
    return apply_template(
        F.lit(template),
        {
            "system_prompt": F.lit(system_prompt),
            "data": row_as_text(query, description, context),
            "prompt": F.lit(prompt),
            "lead_answer_prompt": F.lit(lead),
        },
        "[", "]",
    )


def template_for_model(model: Column) -> Column:
    """Template of the first family whose name occurs in the model id; null if there is none."""
    lowered = F.lower(model)
    choice = F.lit(None).cast("string")
    for family, template in reversed(MODEL_TEMPLATES.items()):
        choice = F.when(F.contains(lowered, F.lit(family)), F.lit(template)).otherwise(choice)
    return choice


def label_text(target: Column, start: str, end: str) -> Column:
    return F.concat(F.lit("\n" + start), target, F.lit(end))


def training_text(template: Column, question: Column, target: Column, start: str, end: str, with_target: bool = True) -> Column:
    text = F.replace(
        F.replace(template, F.lit("[system_prompt]"), F.lit(ELABORATE_INSTRUCTION)), F.lit("[prompt]"), question
    )
    return F.concat(text, label_text(target, start, end)) if with_target else text


def training_text_one_line(template: Column, question: Column, target: Column, start: str, end: str) -> Column:
    """The older layout: short instruction, no newline before the answer."""
    text = apply_template(template, {"system_prompt": F.lit(BASIC_INSTRUCTION), "prompt": question}, "[", "]")
    return F.concat(text, F.lit(start), target, F.lit(end))


def few_shot_prompt(
    template: Column, question: Column, examples: Column, target: Column, start: str, end: str, with_target: bool = False
) -> Column:
    """``examples`` is array<struct<question, target>>; the system block leaves the template."""
    shown = F.array_join(
        F.transform(
            examples,
            lambda x: F.concat(
                F.lit("Input: "), x["question"], F.lit("\nOutput: " + start), x["target"], F.lit(end + "\n\n")
            ),
        ),
        "",
    )
    block = F.when(F.size(examples) > 0, F.concat(F.lit(FEW_SHOT_LEAD), shown)).otherwise(F.lit(""))
    prompt = F.concat(F.replace(F.lit(FEW_SHOT_INSTRUCTION), F.lit("[examples]"), block), question)
    bare = F.replace(F.replace(template, F.lit(SYSTEM_BLOCK), F.lit("")), F.lit("[system_prompt]"), F.lit(""))
    text = F.replace(bare, F.lit("[prompt]"), prompt)
    return F.concat(text, label_text(target, start, end)) if with_target else text


# ---- cleaning -----------------------------------------------------------------------------------


def quoted_sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTED_CAPITAL), 0)


def answers_acceptable(sentences: Column) -> Column:
    banned = F.exists(
        sentences,
        lambda s: F.contains(s, F.lit(BANNED_WORDS[0])) | F.contains(s, F.lit(BANNED_WORDS[1])),
    )
    return F.coalesce((F.size(sentences) > 0) & ~banned, F.lit(False))


def strip_comments(query: Column) -> Column:
    return F.regexp_replace(query, COMMENT, "")


def is_single_hop(query: Column) -> Column:
    return F.coalesce(F.regexp_count(query, F.lit(SINGLE_HOP)) == 1, F.lit(False))


def strip_markup(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, MARKUP, " "), MARKUP_ATTRIBUTE, " ")
    return F.replace(strip(bare), F.lit("\n\n"), F.lit("\n"))


def strip_urls(text: Column) -> Column:
    return F.replace(strip(F.regexp_replace(text, URL, " ")), F.lit("\n\n"), F.lit("\n"))


def drop_prefix_lines(query: Column) -> Column:
    return F.regexp_replace(query, PREFIX_LINE, "")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def sentence_lines(text: Column) -> Column:
    return F.regexp_replace(strip(text), SENTENCE_END, "$1\n")


def search_text(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def short_model_name(name: Column) -> Column:
    return F.substring_index(name, "-", -3)


def generation_error(status: Column) -> Column:
    return (
        F.when(status == "", F.lit("no"))
        .when(F.startswith(status, F.lit(NO_MATCH_STATUS)), F.lit("NoSparqlMatch"))
        .otherwise(F.lit("other"))
    )
