"""Query-text rewriting, prompts, labelling."""

import re

from pyspark.sql import functions as F

from quercus.fixed_values import (
    BASIC_INSTRUCTION, ELABORATE_HEAD, ELABORATE_INSTRUCTION, ELABORATE_TAIL, FEW_SHOT_LEAD, MODEL_TEMPLATES, PREFIXES, SYSTEM_BLOCK,
)
from quercus.functions import text as tx
from quercus.operators import labels as lb, prompts as pr, sampling, steps as sp
from quercus.operators.experiments import template_for_model
from quercus.plans.corpus import FEW_SHOT_SQL, HASH, QUESTIONS, pick_sql, questions
from quercus.plans.registry import query
from quercus.sources.tables import answers, documents, label_dict, queries, runs, table


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PREFIX_ROWS = ", ".join(f"({i}, {lit(k)}, {lit(f'PREFIX {k}: <{v}>')})" for i, (k, v) in enumerate(PREFIXES.items()))


def headers(t, c):
    """CTEs with the header of each row: one line per prefix that is used and not declared."""
    return (
        f"px AS (SELECT * FROM (VALUES {PREFIX_ROWS}) AS t(pos, prefix, line)), "
        f"used AS (SELECT row_id, {c} AS q, unnest(list_distinct(regexp_extract_all({c}, '[^\\p{{L}}\\p{{N}}_]([\\p{{L}}\\p{{N}}_]+):', 1))) AS prefix FROM {t}), "
        "heads AS (SELECT row_id, string_agg(line || chr(10), '' ORDER BY pos) AS h FROM used JOIN px USING (prefix) "
        "WHERE NOT contains(q, line) GROUP BY row_id)"
    )


CAN_LIMIT = "(NOT contains({c}, 'COUNT(') AND NOT regexp_matches(upper({c}), '\\s+LIMIT\\s+\\d+(\\s|$)') AND trim({c}) <> '')"


@query(f"WITH {headers('queries', 'query')} SELECT row_id, CASE WHEN h IS NULL THEN query ELSE h || chr(10) || query END AS query FROM queries LEFT JOIN heads USING (row_id)", ["queries"])
def add_prefixes(spark, sf):
    return queries(spark, sf).select("row_id", tx.add_prefixes(F.col("query")).alias("query"))


@query(f"SELECT row_id, {CAN_LIMIT.format(c='query')} AS can_limit FROM queries", ["queries"])
def can_add_limit(spark, sf):
    return queries(spark, sf).select("row_id", tx.can_add_limit(F.col("query")).alias("can_limit"))


@query(f"SELECT row_id, CASE WHEN {CAN_LIMIT.format(c='query')} THEN query || chr(10) || 'LIMIT 25' ELSE query END AS query FROM queries", ["queries"])
def add_limit(spark, sf):
    return queries(spark, sf).select("row_id", tx.add_limit(F.col("query"), 25).alias("query"))


@query("SELECT row_id, regexp_matches(context, '^\\s*$') AS is_empty FROM queries", ["queries"])
def is_query_empty(spark, sf):
    return queries(spark, sf).select("row_id", tx.is_blank(F.col("context")).alias("is_empty"))


TAGGED = "nullif(regexp_extract(answer, '(?s)\\[query\\](.*)\\[/query\\]', 1), '')"


@query(f"SELECT row_id, {TAGGED} AS query FROM answers", ["answers"])
def extract_tagged(spark, sf):
    return answers(spark, sf).select("row_id", tx.extract_tagged(F.col("answer"), "[query]", "[/query]").alias("query"))


@query(f"SELECT row_id, coalesce(starts_with({TAGGED}, 'SELECT'), false) AS ok FROM answers", ["answers"])
def query_format_ok(spark, sf):
    return answers(spark, sf).select("row_id", tx.query_format_ok(F.col("answer"), "[query]", "[/query]").alias("ok"))


@query(
    "SELECT row_id, nullif(regexp_extract(answer, '(?s)\\[query\\].*?(SELECT.*?)\\[/query\\]', 1), '') AS query, "
    "CASE WHEN regexp_matches(answer, '(?s)\\[query\\].*SELECT.*\\[/query\\]') THEN '' ELSE 'NoSparqlMatch' END AS status FROM answers",
    ["answers"],
)
def extract_query_in_answer(spark, sf):
    a = F.col("answer")
    return answers(spark, sf).select(
        "row_id", tx.query_in_answer(a, "[query]", "[/query]").alias("query"),
        tx.query_in_answer_status(a, "[query]", "[/query]").alias("status"),
    )


@query(
    f"WITH t AS (SELECT row_id, replace({TAGGED}, 'SELECT ?x', 'SELECT wd:x') AS q FROM answers), {headers('t', 'q')} "
    f"SELECT row_id, CASE WHEN q IS NULL THEN 'exception: query is empty' ELSE coalesce(h || chr(10), '') || q || CASE WHEN {CAN_LIMIT.format(c='q')} "
    "THEN chr(10) || 'LIMIT 10' ELSE '' END END AS executed_query FROM t LEFT JOIN heads USING (row_id)",
    ["answers"],
)
def prepare_query(spark, sf):
    answer = F.replace("answer", F.lit("SELECT ?x"), F.lit("SELECT wd:x"))
    return answers(spark, sf).select("row_id", tx.prepare_query(answer, "[query]", "[/query]").alias("executed_query"))


@query("SELECT row_id, array_to_string(regexp_extract_all(query, ':([QPL]\\d+)', 1), '|') AS ids FROM queries", ["queries"])
def extract_ids(spark, sf):
    return queries(spark, sf).select("row_id", F.array_join(tx.extract_ids(F.col("query")), "|").alias("ids"))


BEST_LABELS = "bl AS (SELECT id, arg_min(trim(label), {'a': lang <> 'en', 'b': lang, 'c': label}) AS label FROM label_dict GROUP BY id)"


@query(
    f"WITH {BEST_LABELS}, u AS (SELECT DISTINCT unnest(regexp_extract_all(query, ':([QPL]\\d+)', 1)) AS id FROM queries) "
    "SELECT id, coalesce(label, id) AS label FROM u LEFT JOIN bl USING (id)",
    ["queries", "label_dict"],
)
def label_lookup(spark, sf):
    ids = queries(spark, sf).select(F.explode(tx.extract_ids(F.col("query"))).alias("id"))
    return lb.label_lookup(ids, label_dict(spark, sf))


LABELLED = f"""{BEST_LABELS}, labelled AS (SELECT q.row_id, q.query, replace(replace(q.query, ':' || p.id || ' ', ':[property:' || coalesce(pl.label, p.id) || '] '),
 ':' || p.eid, ':[entity:' || coalesce(el.label, p.eid) || ']') AS query_templated FROM queries q
 JOIN (SELECT o_orderkey AS row_id, 'P' || (o_orderkey % 2000) AS id, 'Q' || (o_custkey % 100) AS eid FROM orders) p USING (row_id)
 LEFT JOIN bl pl ON pl.id = p.id LEFT JOIN bl el ON el.id = p.eid)"""


@query(f"WITH {LABELLED} SELECT row_id, query_templated FROM labelled", ["queries", "label_dict"])
def label_query(spark, sf):
    return lb.label_query(queries(spark, sf), label_dict(spark, sf)).select("row_id", "query_templated")


@query(
    f"WITH {LABELLED} SELECT row_id, array_to_string(regexp_extract_all(query_templated, '\\[entity:([\\p{{L}}\\p{{N}}_\\s,:;''`\".!?]+)\\]', 1), '|') AS entities, "
    "array_to_string(regexp_extract_all(query_templated, '\\[property:([\\p{L}\\p{N}_\\s,:;''`\".!?]+)\\]', 1), '|') AS properties FROM labelled",
    ["queries", "label_dict"],
)
def extract_placeholders(spark, sf):
    df = lb.with_placeholders(lb.label_query(queries(spark, sf), label_dict(spark, sf)), "query_templated")
    return df.select(
        "row_id", F.array_join("extracted_entities", "|").alias("entities"), F.array_join("extracted_properties", "|").alias("properties")
    )


FIRST_HITS = """hits AS (SELECT kind, lower(trim(label)) AS norm, arg_min({'id': id, 'matched': label}, {'n': substr(id, 2)::BIGINT, 'id': id, 'm': label}) AS hit
 FROM label_dict GROUP BY ALL)"""


@query(
    f"""WITH {FIRST_HITS}, w AS (SELECT s_name AS label, 'entity' AS kind FROM supplier UNION SELECT upper(p_name), 'property' FROM part
 UNION SELECT p_name, 'entity' FROM part UNION SELECT DISTINCT p_brand, 'property' FROM part)
SELECT w.label, w.kind, coalesce(a.hit.id, b.hit.id, w.label) AS id, coalesce(a.hit.matched, b.hit.matched, w.label) AS matched FROM w
 LEFT JOIN hits a ON a.norm = lower(trim(w.label)) AND a.kind = w.kind LEFT JOIN hits b ON b.norm = lower(trim(w.label)) AND b.kind <> w.kind""",
    ["label_dict"],
)
def link_take_first(spark, sf):
    p = table(spark, sf, "part")

    def wanted(df, label, kind):
        return df.select(label.alias("label"), F.lit(kind).alias("kind"))

    labels = (
        wanted(table(spark, sf, "supplier"), F.col("s_name"), "entity")
        .unionByName(wanted(p, F.upper("p_name"), "property"))
        .unionByName(wanted(p, F.col("p_name"), "entity"))
        .unionByName(wanted(p, F.col("p_brand"), "property"))
        .distinct()
    )
    return lb.link_take_first(labels, label_dict(spark, sf))


@query(
    f"""WITH {BEST_LABELS}, w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS label, 'property' AS kind FROM part
 UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'entity' FROM part UNION SELECT left(p_name, length(p_name) - 2), 'property' FROM part
 UNION SELECT left(s_name, length(s_name) - 1), 'entity' FROM supplier UNION SELECT upper(s_name), 'entity' FROM supplier
 UNION SELECT DISTINCT p_brand, 'property' FROM part),
q AS (SELECT DISTINCT lower(trim(label)) AS norm FROM w), d AS (SELECT *, lower(trim(label)) AS text, substr(id, 2)::BIGINT AS n FROM label_dict),
h AS (SELECT q.norm, d.kind, min({{'rank': CASE WHEN d.text = q.norm THEN 0 WHEN starts_with(d.text, q.norm) THEN 1 ELSE 2 END, 'n': d.n, 'id': d.id, 'matched': d.label}}) AS hit
 FROM q JOIN d ON contains(' ' || d.text, ' ' || q.norm) WHERE q.norm <> '' GROUP BY ALL),
f AS (SELECT w.label, w.kind, coalesce(a.hit, b.hit) AS hit FROM w LEFT JOIN h a ON a.norm = lower(trim(w.label)) AND a.kind = w.kind
 LEFT JOIN h b ON b.norm = lower(trim(w.label)) AND b.kind <> w.kind),
r AS (SELECT concat('P', p_partkey) AS id, concat('P', p_partkey + 1) AS target FROM part WHERE p_partkey % 5 = 1)
SELECT f.label, f.kind, coalesce(r.target, f.hit.id, f.label) AS id, CASE WHEN r.target IS NOT NULL THEN coalesce(bl.label, r.target) ELSE coalesce(f.hit.matched, f.label) END AS matched,
 f.hit.rank AS rank FROM f LEFT JOIN r ON r.id = f.hit.id LEFT JOIN bl ON bl.id = r.target""",
    ["label_dict"],
)
def link_search_hits(spark, sf):
    """Words and cut names, as a search gets them; every fifth part was moved to the next number."""
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    word = F.split("p_name", " ")

    def wanted(df, label, kind):
        return df.select(label.alias("label"), F.lit(kind).alias("kind"))

    labels = (
        wanted(p, F.try_element_at(word, F.lit(1)), "property").unionByName(wanted(p, F.coalesce(F.try_element_at(word, F.lit(2)), F.lit("")), "entity"))
        .unionByName(wanted(p, F.col("p_name").substr(F.lit(1), F.length("p_name") - 2), "property"))
        .unionByName(wanted(s, F.col("s_name").substr(F.lit(1), F.length("s_name") - 1), "entity"))
        .unionByName(wanted(s, F.upper("s_name"), "entity")).unionByName(wanted(p, F.col("p_brand"), "property")).distinct()
    )
    moved = p.filter("p_partkey % 5 = 1").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.concat(F.lit("P"), F.col("p_partkey") + 1).alias("target")
    )
    return lb.search_hits(labels, label_dict(spark, sf), moved)


FILLED = f"""{LABELLED}, {FIRST_HITS},
parts AS (SELECT row_id, query_templated, regexp_extract(query_templated, '\\[entity:([^\\]]*)\\]', 1) AS e, regexp_extract(query_templated, '\\[property:([^\\]]*)\\]', 1) AS p,
 regexp_matches(regexp_extract(query_templated, '\\[entity:([^\\]]*)\\]', 1), '^[\\p{{L}}\\p{{N}}_\\s,:;''`".!?]+$') AS e_ok FROM labelled),
filled AS (SELECT row_id, replace(CASE WHEN e_ok THEN replace(query_templated, '[entity:' || e || ']', coalesce(he.hit.id, ge.hit.id, e)) ELSE query_templated END,
 '[property:' || p || ']', coalesce(hp.hit.id, gp.hit.id, p)) AS output FROM parts
 LEFT JOIN hits he ON he.kind = 'entity' AND he.norm = lower(trim(e)) LEFT JOIN hits ge ON ge.kind = 'property' AND ge.norm = lower(trim(e))
 LEFT JOIN hits hp ON hp.kind = 'property' AND hp.norm = lower(trim(p)) LEFT JOIN hits gp ON gp.kind = 'entity' AND gp.norm = lower(trim(p)))"""


@query(f"WITH {FILLED} SELECT row_id, output FROM filled", ["queries", "label_dict"])
def fill_placeholders(spark, sf):
    dictionary = label_dict(spark, sf)
    df = lb.with_placeholders(lb.label_query(queries(spark, sf), dictionary), "query_templated")
    df = lb.link_placeholders(df, dictionary)
    filled = tx.fill_placeholders(F.col("query_templated"), F.col("linked_entities"), F.col("linked_properties"))
    return df.select("row_id", filled.alias("output"))


@query(
    """WITH t AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN p_name
 WHEN p_partkey % 10 = 2 THEN 'Entities: [] Properties: []' WHEN p_partkey % 10 = 3 THEN 'Entities: [' || p_brand || '] Properties: []'
 ELSE 'Entities: [' || p_name || ', ' || p_brand || ']' || chr(10) || 'Properties: [ ' || p_type || ' ]' END AS text, * FROM part)
SELECT row_id, CASE WHEN p_partkey % 10 = 3 THEN p_brand WHEN p_partkey % 10 > 3 THEN p_name || '|' || p_brand END AS entities,
 CASE WHEN p_partkey % 10 = 3 THEN '' WHEN p_partkey % 10 > 3 THEN p_type END AS properties,
 CASE p_partkey % 10 WHEN 0 THEN 'The generated answer by the LLM is empty.' WHEN 1 THEN 'The format of the response is not correct.'
 WHEN 2 THEN 'Nothing has been extracted.' END AS error FROM t"""
)
def parse_entity_listing(spark, sf):
    key, name, brand, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    text = (
        F.when(key % 10 == 0, F.lit("")).when(key % 10 == 1, name).when(key % 10 == 2, F.lit("Entities: [] Properties: []"))
        .when(key % 10 == 3, F.concat(F.lit("Entities: ["), brand, F.lit("] Properties: []")))
        .otherwise(F.concat(F.lit("Entities: ["), name, F.lit(", "), brand, F.lit("]\nProperties: [ "), kind, F.lit(" ]")))
    )
    df = table(spark, sf, "part").select(key.alias("row_id"), tx.parse_entity_listing(text).alias("x"))
    return df.select("row_id", F.array_join("x.entities", "|").alias("entities"), F.array_join("x.properties", "|").alias("properties"), "x.error")


@query(
    """SELECT conv_id * 1000 + turn AS row_id, replace(replace(replace(text, w[1], '[entity 0]'), w[3], '[entity 1]'), w[2], '[property 0]') AS annotated_sentence
 FROM (SELECT *, string_split(text, ' ') AS w FROM conversations) WHERE len(w) >= 3"""
)
def annotate_sentence(spark, sf):
    w = F.split("text", " ")
    df = table(spark, sf, "conversations").filter(F.size(w) >= 3)
    marked = tx.annotate_sentence(F.col("text"), F.array(w[0], w[2]), F.array(w[1]))
    return df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), marked.alias("annotated_sentence"))


@query("SELECT doc_id AS row_id, 'In ' || lang || ' from ' || source || ': ' || replace(replace(text, '<lang>', lang), '<n>', CAST(n_chars AS VARCHAR)) || ' (' || n_chars || ')' AS prompt FROM documents")
def apply_template(spark, sf):
    values = {"text": F.col("text"), "lang": F.col("lang"), "source": F.col("source"), "n": F.col("n_chars")}
    return documents(spark, sf).select(
        "row_id", tx.apply_template(F.lit("In <lang> from <source>: <text> (<n>)"), values, "<", ">").alias("prompt")
    )


@query(
    "SELECT row_id, '<s> be brief QUERY=\"' || query || '\" DESCRIPTION=\"' || description || '\" CONTEXT=\"' || context || '\" ask. Answer:' AS prompt FROM queries",
    ["queries"],
)
def build_generation_prompt(spark, sf):
    prompt = tx.generation_prompt(
        F.col("query"), F.col("description"), F.col("context"),
        "<s> [system_prompt] [data] [prompt] [lead_answer_prompt]", "be brief", "ask.", "Answer:",
    )
    return queries(spark, sf).select("row_id", prompt.alias("prompt"))


@query(
    "WITH p AS (SELECT row_id, 'Ask QUERY=\"' || query || '\" DESCRIPTION=\"' || description || '\" CONTEXT=\"' || context || '\"' AS prompt, '\"' || CASE WHEN row_id % 3 = 0 THEN 'GROUP ' ELSE 'Which ' END || description || '\"' AS answer, row_id % 3 <> 0 AS ok FROM queries), "
    "t AS (SELECT *, len(regexp_extract_all(prompt, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM p) "
    "SELECT row_id, n AS num_tokens, n > 40 AS too_long, n > 40 OR NOT ok AS is_skipped, CASE WHEN n <= 40 AND ok THEN answer END AS result FROM t",
    ["queries"],
)
def prepare_prompts(spark, sf):
    """Prompt columns of a generation run, and their result for an answer made from the description."""
    prompt = tx.apply_template(F.lit("Ask [data]"), {"data": tx.row_as_text(F.col("query"), F.col("description"), F.col("context"))}, "[", "]")
    df = pr.prepare_prompts(queries(spark, sf), prompt)
    answer = F.concat(F.when(F.col("row_id") % 3 == 0, F.lit('"GROUP ')).otherwise('"Which '), F.col("description"), F.lit('"'))
    sentences = tx.quoted_sentences(answer)
    df = pr.generation_result(df, sentences, answer, tx.answers_acceptable(sentences), 40)
    return df.select(
        "row_id", F.col("basic_num_tokens").alias("num_tokens"), F.col("basic_is_prompt_too_long").alias("too_long"),
        F.col("basic_is_skipped").alias("is_skipped"), F.array_join("basic_result", "|").alias("result"),
    )


MODELS = "CASE run_id % 5 WHEN 0 THEN 'meta/Llama-2-7b' WHEN 1 THEN 'Meta-Llama-3-8B' WHEN 2 THEN 'CodeLlama-13b' WHEN 3 THEN 'Mistral-7B' ELSE model END"


def model_id(key):
    names = {0: "meta/Llama-2-7b", 1: "Meta-Llama-3-8B", 2: "CodeLlama-13b", 3: "Mistral-7B"}
    choice = F.col("model")
    for rest, name in names.items():
        choice = F.when(key % 5 == rest, F.lit(name)).otherwise(choice)
    return choice


@query(
    f"SELECT run_id, m AS model_id, CASE WHEN m = 'meta/Llama-2-7b' THEN {lit(MODEL_TEMPLATES['llama-2'])} WHEN m = 'Meta-Llama-3-8B' THEN {lit(MODEL_TEMPLATES['llama-3'])} "
    f"WHEN m = 'CodeLlama-13b' THEN {lit(MODEL_TEMPLATES['codellama'])} WHEN m = 'Mistral-7B' THEN {lit(MODEL_TEMPLATES['mistral'])} END AS template "
    f"FROM (SELECT run_id, {MODELS} AS m FROM runs)",
    ["runs"],
    name="template_for_model",
)
def template_for_model_query(spark, sf):
    df = runs(spark, sf).select("run_id", model_id(F.col("run_id")).alias("model_id"))
    return df.withColumn("template", template_for_model(F.col("model_id")))


@query(
    f"""WITH q AS (SELECT row_id, {pick_sql(7)} AS question, target FROM {QUESTIONS})
SELECT row_id, replace({lit(MODEL_TEMPLATES['mistral'].replace('[system_prompt]', ELABORATE_INSTRUCTION))}, '[prompt]', question) || chr(10) || '[query]' || target || '[/query]' AS text,
 chr(10) || '[query]' || target || '[/query]' AS label,
 replace({lit(MODEL_TEMPLATES['mistral'].replace('[system_prompt]', BASIC_INSTRUCTION))}, '[prompt]', question) || '[query]' || target || '[/query]' AS text_one_line FROM q"""
)
def build_training_text(spark, sf):
    template, tags = F.lit(MODEL_TEMPLATES["mistral"]), ("[query]", "[/query]")
    df = questions(spark, sf).withColumn("question", sampling.pick_one(F.col("inputs"), 7, F.col("row_id")))
    return df.select(
        "row_id",
        tx.training_text(template, F.col("question"), F.col("target"), *tags).alias("text"),
        tx.label_text(F.col("target"), *tags).alias("label"),
        tx.training_text_one_line(template, F.col("question"), F.col("target"), *tags).alias("text_one_line"),
    )


FEW_SHOT_TEXT = FEW_SHOT_SQL[: FEW_SHOT_SQL.rindex("SELECT q.row_id")].replace(
    "AS question FROM a JOIN", "AS question, p.target FROM a JOIN"
)


@query(
    FEW_SHOT_TEXT
    + f""", x AS (SELECT q.row_id, any_value({pick_sql(9, "q.row_id", "q.inputs")}) AS own, any_value(q.target) AS own_target,
 string_agg('Input: ' || e.question || chr(10) || 'Output: [query]' || e.target || '[/query]' || chr(10) || chr(10), '' ORDER BY j) AS shown FROM q LEFT JOIN e USING (row_id) GROUP BY q.row_id)
SELECT row_id, replace({lit(MODEL_TEMPLATES['llama-3'].replace(SYSTEM_BLOCK, ''))}, '[prompt]', {lit(ELABORATE_HEAD)} || coalesce({lit(FEW_SHOT_LEAD)} || shown, '') || {lit(chr(10) + ELABORATE_TAIL)} || own)
 || chr(10) || '[query]' || own_target || '[/query]' AS text FROM x"""
)
def build_few_shot_prompt(spark, sf):
    df = sampling.few_shot_examples(questions(spark, sf), 3, seed=3, batch=100)
    own = sampling.pick_one(F.col("inputs"), 9, F.col("row_id"))
    text = tx.few_shot_prompt(F.lit(MODEL_TEMPLATES["llama-3"]), own, F.col("examples"), F.col("target"), "[query]", "[/query]", True)
    return df.select("row_id", text.alias("text"))


@query("SELECT doc_id AS row_id, array_to_string(regexp_extract_all('\"' || replace(text, '. ', '.\" \"' || chr(10)) || '\"', '\"[A-Z].*\"'), '|') AS quoted FROM documents")
def quoted_sentences(spark, sf):
    text = F.concat(F.lit('"'), F.replace("text", F.lit(". "), F.lit('." "\n')), F.lit('"'))
    return documents(spark, sf).select("row_id", F.array_join(tx.quoted_sentences(text), "|").alias("quoted"))


@query(
    "SELECT doc_id AS row_id, len(q) > 0 AND NOT regexp_matches(array_to_string(q, '|'), 'SELECT|GROUP') AS ok FROM "
    "(SELECT doc_id, regexp_extract_all('\"' || replace(text, 'The', 'SELECT') || '\"', '\"[A-Z].*\"') AS q FROM documents)"
)
def answers_acceptable(spark, sf):
    text = F.concat(F.lit('"'), F.replace("text", F.lit("The"), F.lit("SELECT")), F.lit('"'))
    return documents(spark, sf).select("row_id", tx.answers_acceptable(tx.quoted_sentences(text)).alias("ok"))


@query("SELECT row_id, regexp_replace(query, '#.*', '', 'g') AS query FROM queries", ["queries"])
def strip_comments(spark, sf):
    return queries(spark, sf).select("row_id", tx.strip_comments(F.col("query")).alias("query"))


@query("SELECT row_id, regexp_matches(query, 'wd:Q[0-9]+\\s+}') AS single_hop FROM queries", ["queries"])
def is_single_hop(spark, sf):
    return queries(spark, sf).select("row_id", tx.is_single_hop(tx.strip_comments(F.col("query"))).alias("single_hop"))


@query(
    r"""SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(html, '</?[a-zA-z?;="'' ]*>|<.+[^\p{L}\p{N}_]>', ' ', 'g'),
 '(?:class|colspan|style|rowspan)=".+"', ' ', 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10), chr(10)) AS text FROM pages"""
)
def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query(
    r"""SELECT page_id, replace(regexp_replace(regexp_replace('see ' || replace(url, 'http:', 'https:') || chr(10) || chr(10) || url || ' end', 'https:[a-zA-Z%:./#_0-9]+', ' ', 'g'),
 '^\s+|\s+$', '', 'g'), chr(10) || chr(10), chr(10)) AS text FROM pages"""
)
def strip_urls(spark, sf):
    text = F.concat(F.lit("see "), F.replace("url", F.lit("http:"), F.lit("https:")), F.lit("\n\n"), F.col("url"), F.lit(" end"))
    return table(spark, sf, "pages").select("page_id", tx.strip_urls(text).alias("text"))


@query("SELECT doc_id AS row_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS num_tokens FROM documents")
def count_tokens(spark, sf):
    return documents(spark, sf).select("row_id", tx.count_tokens(F.col("text")).alias("num_tokens"))


@query("SELECT doc_id AS row_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g') AS text FROM documents")
def sentence_lines(spark, sf):
    return documents(spark, sf).select("row_id", tx.sentence_lines(F.col("text")).alias("text"))


@query(
    "SELECT row_id, CASE WHEN attempt % 2 = 1 THEN 'SELECT ?x WHERE { ?x ?p ' || row_id || ' }' || chr(10) || 'LIMIT 3' END AS generated FROM answers",
    ["answers"],
)
def recover_from_status(spark, sf):
    stored = F.concat(
        F.col("status"), F.lit(": err.sparql='[INST] q [/INST] SELECT ?x WHERE { ?x ?p "), F.col("row_id").cast("string"), F.lit(" }\\nLIMIT 3'")
    )
    status = F.when(F.col("attempt") % 2 == 1, stored).otherwise(F.col("status"))
    return answers(spark, sf).select("row_id", tx.recover_from_status(status).alias("generated"))


@query("SELECT row_id, replace('`sparql' || chr(92) || 'n' || answer, chr(92) || 'n', chr(10)) AS answer FROM answers", ["answers"])
def unescape_tag(spark, sf):
    return answers(spark, sf).select("row_id", tx.unescape_tag(F.concat(F.lit("`sparql\\n"), F.col("answer"))).alias("answer"))


@query("SELECT row_id, regexp_replace(query, 'PREFIX [\\p{L}\\p{N}_]+:.*' || chr(10), '', 'g') AS query FROM queries", ["queries"])
def drop_prefix_lines(spark, sf):
    return queries(spark, sf).select("row_id", tx.drop_prefix_lines(F.col("query")).alias("query"))


@query("SELECT row_id, len(regexp_extract_all(query, ':([QPL]\\d+)', 1)) AS n_ids, length(query) - length(replace(query, chr(10), '')) + 1 AS n_lines, "
       "len(list_distinct(regexp_split_to_array(query, '\\s+'))) AS n_different FROM queries", ["queries"])
def parallel_row_apply(spark, sf):
    """A caller's Python function over all rows, in Arrow batches of the one column that it reads."""

    def study(row):
        words = set(re.split(r"\s+", row["query"]))
        return {"n_ids": len(re.findall(r":([QPL]\d+)", row["query"])), "n_lines": row["query"].count("\n") + 1, "n_different": len(words)}

    return sp.apply_rows(queries(spark, sf), study, "n_ids bigint, n_lines bigint, n_different bigint", ["query"], "row_id")
