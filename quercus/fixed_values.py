"""Tables, patterns and texts that results depend on literally."""

# Prefix -> IRI, in the order in which header lines are written.
PREFIXES = {
    "bd": "http://www.bigdata.com/rdf#",
    "cc": "http://creativecommons.org/ns#",
    "dct": "http://purl.org/dc/terms/",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "hint": "http://www.bigdata.com/queryHints#",
    "ontolex": "http://www.w3.org/ns/lemon/ontolex#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "prov": "http://www.w3.org/ns/prov#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "schema": "http://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "p": "http://www.wikidata.org/prop/",
    "pq": "http://www.wikidata.org/prop/qualifier/",
    "pqn": "http://www.wikidata.org/prop/qualifier/value-normalized/",
    "pqv": "http://www.wikidata.org/prop/qualifier/value/",
    "pr": "http://www.wikidata.org/prop/reference/",
    "prn": "http://www.wikidata.org/prop/reference/value-normalized/",
    "prv": "http://www.wikidata.org/prop/reference/value/",
    "psv": "http://www.wikidata.org/prop/statement/value/",
    "ps": "http://www.wikidata.org/prop/statement/",
    "psn": "http://www.wikidata.org/prop/statement/value-normalized/",
    "wd": "http://www.wikidata.org/entity/",
    "wdata": "http://www.wikidata.org/wiki/Special:EntityData/",
    "wdno": "http://www.wikidata.org/prop/novalue/",
    "wdref": "http://www.wikidata.org/reference/",
    "wds": "http://www.wikidata.org/entity/statement/",
    "wdt": "http://www.wikidata.org/prop/direct/",
    "wdtn": "http://www.wikidata.org/prop/direct-normalized/",
    "wdv": "http://www.wikidata.org/value/",
    "wikibase": "http://wikiba.se/ontology#",
    "lgdo": "http://linkedgeodata.org/ontology/",
    "geom": "http://geovocab.org/geometry#",
    "bif": "http://www.openlinksw.com/schemas/bif#",
    "wp": "http://vocabularies.wikipathways.org/wp#",
    "dcterms": "http://purl.org/dc/terms/",
    "gas": "http://www.bigdata.com/rdf/gas#",
    "void": "http://rdfs.org/ns/void#",
    "pav": "http://purl.org/pav/",
    "freq": "http://purl.org/cld/freq/",
    "biopax": "http://www.biopax.org/release/biopax-level3.owl#",
    "gpml": "http://vocabularies.wikipathways.org/gpml#",
    "wprdf": "http://rdf.wikipathways.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "vrank": "http://purl.org/voc/vrank#",
    "nobel": "http://data.nobelprize.org/terms/",
    "dbc": "http://dbpedia.org/resource/Category:",
    "dbd": "http://dbpedia.org/datatype/",
    "dbo": "http://dbpedia.org/ontology/",
    "dbp": "http://dbpedia.org/property/",
    "dbr": "http://dbpedia.org/resource/",
    "dbt": "http://dbpedia.org/resource/Template:",
    "wikibaseβ": "http://wikiba.se/ontology-beta#",
}

# Statuses of an execution, in report order.
STATUSES = ["timeout", "fail", "empty", "to_eval", "missing"]

# Error class -> number.
ERROR_INDEX = {
    "undefined prefix": 0,
    "parse exception due to limit": 1,
    "parse exception": 2,
    "lexical error": 3,
    "non-aggregate variable in select expression": 4,
    "Prefix duplicates": 5,
    "stack overflow": 6,
    "GeoSpatialSearchException: input could not be resolved as point": 7,
    "estimated time to execute too long": 8,
    "Out of memory": 9,
    "no attribute 'JSONDecodeError'": 10,
    "Invalid JSON": 11,
    "server timeout": 12,
    "NullPointerException": 13,
    "empty query": 14,
}

# Words that make a generated question unusable.
BANNED_WORDS = ["SELECT", "GROUP"]

XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
ENTITY_IRI_START = "http://www.wikidata.org/"

EMPTY_QUERY_TEXT = "exception: query is empty"
TOO_MANY_RETRIES_TEXT = "exception: too many retry-after"
INVALID_CHUNK_TEXT = "exception: 500 Server Error: the response has an Invalid chunk length: "
NO_MATCH_STATUS = "Unexpected err.msg=\"The LLM result doesn't match desired format.\""

# Prompt templates by model family, tested in this order.
MODEL_TEMPLATES = {
    "llama-2": "[INST] <<SYS>>\n[system_prompt]\n<</SYS>>\n\n[prompt] [/INST] ",
    "llama-3": (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
        "[system_prompt]<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
        "[prompt]<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
    ),
    "codellama": "[INST] [system_prompt]\n[prompt]\n[/INST] ",
    "mistral": "[INST] [system_prompt] [prompt] [/INST] ",
}
SYSTEM_BLOCK = "<|start_header_id|>system<|end_header_id|>\n\n[system_prompt]<|eot_id|>"

# Instruction texts that go into training and few-shot prompts.
BASIC_INSTRUCTION = (
    "Given a question, generate a SPARQL query that answers the question. "
    "Answer this following question or instruction:"
)
ELABORATE_HEAD = (
    "Your assignment involves a two-step process:\n"
    "First, you will receive a task described in a single sentence. This task outlines what "
    "information you need to find or what question you need to answer. Read it properly.\n"
    "Then, you will create a SPARQL Query: Based on the task given, you will write a SPARQL query. "
    "SPARQL is a specialized query language used to retrieve and manipulate data stored in Resource "
    "Description Framework (RDF) format. Your goal is to craft a query that, when executed, fetches "
    "the data or answers required by the initial instruction.\n"
    "Make sure your SPARQL query is correctly formulated so that, upon execution, it produces the "
    "desired result matching the task's requirements.\n"
)
ELABORATE_TAIL = "Answer this following instruction:"
ELABORATE_INSTRUCTION = ELABORATE_HEAD + ELABORATE_TAIL
FEW_SHOT_INSTRUCTION = ELABORATE_HEAD + "[examples]\n" + ELABORATE_TAIL
FEW_SHOT_LEAD = "\n\nHere are some examples:\n\n"

# Abbreviations of optimizer names in run labels.
OPTIMIZER_ALIASES = {"adamw_torch": "awtor", "adamw_bnb_8bit": "awbn8"}

# Metric names of the final report and the families they are studied in.
ANSWER_METRICS = ["map", "precision", "recall", "rr", "overlap", "jaccard", "dice_coeff"]
TRANSLATION_METRICS = ["bleu", "meteor", "rouge1", "rouge2", "rougeL", "rougeLsum", "correct syntax"]
