"""The registered queries as SQL for DuckDB, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions.normalize import EMAIL, LEGAL_SUFFIX, PHONE, STATES, STOPWORDS, STREETS, UNIT
from ..functions.similarity import ALIASES, DIRECTIONS, FIELD_TYPES, NAME_PARTS, STREET_TYPES
from .fixture import ENTITY_SQL, FIELDS, PAIR_SQL

ENTS = "ents AS (" + ENTITY_SQL.format(customer="customer", part="part", nation="nation") + ")"
PAIRS = "pairs AS (" + PAIR_SQL.format(columns=", ".join(f"x.{f} AS {f}_a, y.{f} AS {f}_b" for f in FIELDS), entities="ents") + ")"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


# Normalizers.
def n_text(x: str) -> str:
    words = ", ".join(map(q, STOPWORDS))
    return f"array_to_string(list_filter(string_split(trim({rx(f'lower({x})', r's+'.replace('s', chr(92) + 's'), ' ')}), ' '), lambda w: NOT list_contains([{words}], w)), ' ')"


def n_name(x: str, compat: bool = False) -> str:
    out = rx(n_text(x), LEGAL_SUFFIX + "$", "", "i")
    return f"trim({out})" if compat else f"trim({rx(out, r'(?i)\b([a-z])\.', chr(92) + '1')})"


def n_address(x: str) -> str:
    out = n_text(x)
    for word, short in STREETS.items():
        out = rx(out, rf"(?i)\b{word}\b\.?", short)
    return f"trim({rx(out, '(?i)' + UNIT)})"


def n_phone(x: str) -> str:
    p = q(PHONE + "$")
    part = lambda k: f"regexp_extract({x}, {p}, {k})"
    return f"CASE WHEN ({x} LIKE '+%' AND strlen({x}) BETWEEN 8 AND 15) OR NOT regexp_matches({x}, {p}) THEN {x} ELSE concat('+', CASE WHEN {part(1)} = '' THEN '1' ELSE {part(1)} END, {part(2)}, {part(3)}, {part(4)}) END"


def n_email(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(EMAIL + '$')}) THEN concat(split_part({x}, '@', 1), '@', lower(split_part({x}, '@', 2))) ELSE {x} END"


def n_state(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in STATES.items())
    return f"CASE WHEN strlen({x}) = 2 THEN upper({x}) ELSE CASE lower({x}) {cases} ELSE {x} END END"


def n_zip(x: str) -> str:
    c = rx(x, "[^0-9a-zA-Z]")
    return f"CASE WHEN length({c}) >= 5 AND regexp_matches({c}, '^[0-9]') THEN {c}[1:5] ELSE {c} END"


NORMAL = {"name": n_name, "address": n_address, "city": n_text, "state": n_state, "zip": n_zip, "phone": n_phone, "email": n_email}
NORM = "norm AS (SELECT *, " + ", ".join(f"{NORMAL[f](f)} AS {f}_normalized" for f in FIELDS) + " FROM ents)"
ALL_FIELDS = sorted([*FIELDS, *[f"{f}_normalized" for f in FIELDS]])
COMBINED = "array_to_string(list_filter([" + ", ".join(ALL_FIELDS) + "], lambda x: x <> ''), ' ')"
KEY = "concat(CASE WHEN coalesce(nullif(name_normalized, ''), name) <> '' THEN concat(coalesce(nullif(name_normalized, ''), name)[1:3], '|') ELSE '' END, CASE WHEN coalesce(nullif(zip_normalized, ''), zip) <> '' THEN concat(coalesce(nullif(zip_normalized, ''), zip)[1:5], '|') ELSE '' END)"
BLOCKED = f"blocked AS (SELECT *, CASE WHEN {KEY} = '' THEN 'default' ELSE md5({KEY})[1:16] END AS cluster_id FROM norm)"


# Comparators.
def rule(a: str, b: str, score: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {score} END)::DOUBLE"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(r'[\p{L}\p{N}]+')})"


def jaccard(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    union = f"len(list_distinct(list_concat({x}, {y})))"
    return rule(a, b, f"CASE WHEN {union} = 0 THEN 0.0 ELSE len(list_distinct(list_intersect({x}, {y})))::double / {union} END")


def contained(a: str, b: str) -> str:
    x, y = f"lower({a})", f"lower({b})"
    return rule(a, b, f"CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN least(strlen({x}), strlen({y}))::double / greatest(strlen({x}), strlen({y})) ELSE 0.0 END")


def levenshtein(a: str, b: str) -> str:
    return rule(a, b, f"1 - levenshtein({a}, {b})::double / greatest(strlen({a}), strlen({b}))")


def token_cosine(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    count = lambda ts, w: f"len(list_filter({ts}, lambda t: t = {w}))"
    dot = f"list_sum(list_transform(list_distinct(list_intersect({x}, {y})), lambda w: ({count(x, 'w')} * {count(y, 'w')})::double))"
    norm = lambda ts: f"sqrt(list_sum(list_transform(list_distinct({ts}), lambda w: ({count(ts, 'w')} * {count(ts, 'w')})::double)))"
    return rule(a, b, f"coalesce({dot} / ({norm(x)} * {norm(y)}), 0.0)")


def clean_name(x: str) -> str:
    return rx(f"trim({rx(f'lower({x})', LEGAL_SUFFIX + '$')})", r"\s+", " ")


def clean_address(x: str) -> str:
    out = rx(f"lower({x})", UNIT)
    for table in (STREET_TYPES, DIRECTIONS):
        for word, short in table.items():
            if word != short:
                out = rx(out, rf"\b{word}\b", short)
    return rx(f"trim({out})", r"\s+", " ")


def digits(x: str) -> str:
    return rx(x, "[^0-9]")


def phone(a: str, b: str) -> str:
    x, y = digits(a), digits(b)
    p, r = f"right({x}, 10)", f"right({y}, 10)"
    same = f"len(list_filter(range(1, 11), lambda k: length({p}) >= k AND length({r}) >= k AND right({p}, k) = right({r}, k)))"
    score = f"CASE WHEN {same} >= 10 THEN 1.0 WHEN {same} >= 7 THEN 0.9 WHEN {same} >= 4 THEN 0.7 ELSE {same} / 10.0 END"
    return rule(a, b, rule(x, y, f"CASE WHEN {x} = {y} THEN 1.0 ELSE {score} END"))


def zipcode(a: str, b: str) -> str:
    x, y = digits(a), digits(b)
    same = f"len(list_filter(range(1, 6), lambda k: length({x}) >= k AND length({y}) >= k AND left({x}, k) = left({y}, k)))"
    score = f"CASE WHEN {same} >= 5 THEN 0.95 WHEN {same} >= 3 THEN 0.8 WHEN {same} >= 1 THEN 0.5 ELSE 0.0 END"
    return rule(a, b, rule(x, y, f"CASE WHEN {x} = {y} THEN 1.0 ELSE {score} END"))


def jaro_ctes(source: str, name: str = "jaro") -> str:
    """CTEs that end in `name`(a, b, jaro, jw) for the distinct rows of source(a, b)."""
    return f"""
{name}_in AS (SELECT DISTINCT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS d FROM ({source})),
{name}_walk AS (
  SELECT a, b, s, l, d, 0 AS i, CAST([] AS BIGINT[]) AS am, CAST([] AS BIGINT[]) AS bm FROM {name}_in
  UNION ALL
  SELECT a, b, s, l, d, i + 1, CASE WHEN j IS NULL THEN am ELSE list_append(am, i + 1) END, CASE WHEN j IS NULL THEN bm ELSE list_append(bm, j) END
  FROM (SELECT *, list_filter(range(greatest(0, i - d) + 1, least(i + d + 1, length(l)) + 1), lambda x: substr(l, x, 1) = substr(s, i + 1, 1) AND NOT list_contains(bm, x))[1] AS j FROM {name}_walk WHERE i < length(s))),
{name}_end AS (SELECT a, b, s, l, am, list_sort(bm) AS bm FROM {name}_walk WHERE i = length(s)),
{name}_score AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN len(am) = 0 THEN 0.0 ELSE (len(am)::double / length(a) + len(am)::double / length(b) + (len(am) - len(list_filter(range(1, len(am) + 1), lambda k: substr(s, am[k], 1) <> substr(l, bm[k], 1))) / 2.0) / len(am)) / 3 END AS jaro FROM {name}_end),
{name} AS (SELECT a, b, jaro, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE jaro + len(list_filter(range(1, 5), lambda k: length(a) >= k AND length(b) >= k AND left(a, k) = left(b, k))) * 0.1 * (1 - jaro) END AS jw FROM {name}_score)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def name_scores() -> tuple[list[str], str]:
    ctes = [f"named AS (SELECT id_a, id_b, name_a AS ra, name_b AS rb, {clean_name('name_a')} AS ca, {clean_name('name_b')} AS cb FROM pairs)", jaro_ctes("SELECT ca AS a, cb AS b FROM named", "jn")]
    score = rule("ra", "rb", f"CASE WHEN ra = rb OR lower(ca) = lower(cb) THEN 1.0 ELSE 0.6 * jw + 0.3 * {jaccard('ca', 'cb')} + 0.1 * {contained('ca', 'cb')} END")
    return [*ctes, f"name_scored AS (SELECT id_a, id_b, {score} AS score FROM named JOIN jn ON ca = a AND cb = b)"], "name_scored"


def address_scores() -> tuple[list[str], str]:
    first = lambda x: f"regexp_extract({x}, '([0-9]+)', 1)"
    ctes = [f"placed AS (SELECT id_a, id_b, address_a AS ra, address_b AS rb, {clean_address('address_a')} AS ca, {clean_address('address_b')} AS cb FROM pairs)", jaro_ctes("SELECT ca AS a, cb AS b FROM placed", "jd")]
    blend = f"(0.5 * {jaccard('ca', 'cb')} + 0.2 * jw + 0.3 * {contained('ca', 'cb')}) * CASE WHEN {first('ca')} <> '' AND {first('cb')} <> '' AND {first('ca')} <> {first('cb')} THEN 0.3 ELSE 1.0 END"
    score = rule("ra", "rb", f"CASE WHEN ra = rb OR lower(ca) = lower(cb) THEN 1.0 ELSE {blend} END")
    return [*ctes, f"address_scored AS (SELECT id_a, id_b, {score} AS score FROM placed JOIN jd ON ca = a AND cb = b)"], "address_scored"


def email_scores() -> tuple[list[str], str]:
    p = q(r"^([^@]+)@(.+)$")
    whole = f"(NOT regexp_matches(email_a, {p}) OR NOT regexp_matches(email_b, {p}))"
    part = lambda x, k: f"regexp_extract({x}, {p}, {k})"
    ctes = [f"mailed AS (SELECT id_a, id_b, email_a AS ra, email_b AS rb, {whole} AS whole, CASE WHEN {whole} THEN email_a ELSE {part('email_a', 1)} END AS ca, CASE WHEN {whole} THEN email_b ELSE {part('email_b', 1)} END AS cb, lower({part('email_a', 2)}) = lower({part('email_b', 2)}) AS same FROM pairs)", jaro_ctes("SELECT ca AS a, cb AS b FROM mailed", "je")]
    score = rule("ra", "rb", "CASE WHEN ra = rb THEN 1.0 WHEN lower(ra) = lower(rb) THEN 0.99 WHEN whole THEN jw WHEN NOT same THEN 0.0 ELSE 0.4 * jw + 0.6 END")
    return [*ctes, f"email_scored AS (SELECT id_a, id_b, {score} AS score FROM mailed JOIN je ON ca = a AND cb = b)"], "email_scored"


def text_scores(field: str) -> tuple[list[str], str]:
    return [jaro_ctes(f"SELECT {field}_a AS a, {field}_b AS b FROM pairs", f"j_{field}"), f"{field}_scored AS (SELECT id_a, id_b, jw AS score FROM pairs JOIN j_{field} ON a = {field}_a AND b = {field}_b)"], f"{field}_scored"


def plain_scores(field: str, fn) -> tuple[list[str], str]:
    return [f"{field}_scored AS (SELECT id_a, id_b, {fn(f'{field}_a', f'{field}_b')} AS score FROM pairs)"], f"{field}_scored"


def all_scores(exact_name: bool = False) -> tuple[list[str], str]:
    """CTEs, and a FROM clause with s_<field>.score for each field."""
    exact = lambda a, b: f"({a} = {b})::int::double"
    parts = {
        "name": plain_scores("name", exact) if exact_name else name_scores(),
        "address": address_scores(),
        "city": text_scores("city"),
        "state": text_scores("state"),
        "zip": plain_scores("zip", zipcode),
        "phone": plain_scores("phone", phone),
        "email": email_scores(),
    }
    ctes = [c for p in parts.values() for c in p[0]]
    joins = "pairs p " + " ".join(f"JOIN {p[1]} s_{f} ON s_{f}.id_a = p.id_a AND s_{f}.id_b = p.id_b" for f, p in parts.items())
    return ctes, joins


SCORED = {f: f"CASE WHEN p.{f}_a <> '' THEN s_{f}.score END" for f in FIELDS}
WEIGHTS = {"name": 0.4, "address": 0.2, "city": 0.1, "state": 0.05, "zip": 0.05, "phone": 0.1, "email": 0.1}
WEIGHTED = "(" + " + ".join(f"coalesce({SCORED[f]} * {w}, 0.0)" for f, w in WEIGHTS.items()) + ") / (" + " + ".join(f"CASE WHEN {SCORED[f]} IS NOT NULL THEN {w} ELSE 0.0 END" for f, w in WEIGHTS.items()) + ")"
VECTOR_OF_NAME = "list_transform(range(0, 16), lambda i: CASE WHEN i < strlen({0}) THEN (CAST(concat('0x', hex(encode({0}))[2 * i + 1 : 2 * i + 2]) AS INT)::double / 255.0)::float ELSE 0.0::float END)"


def cos(a: str, b: str) -> str:
    x, y = f"{a}::double[]", f"{b}::double[]"
    size = f"(sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y})))"
    return f"CASE WHEN {size} = 0 THEN 0.0 ELSE list_dot_product({x}, {y}) / {size} END"


ASKED = "asked AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0)"
SCORES = f"scores AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label AS q_label, e.label, {cos('q.embedding', 'e.embedding')} AS score FROM asked q, embeddings e)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM scores)"
EDGES = f"edges AS (SELECT x.vec_id AS src, y.vec_id AS dst, {cos('x.embedding', 'y.embedding')} AS score FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id)"


def group_ctes(direct: float, rest: float, hops: int) -> str:
    """First visit by hop, best edge from the hop before; `hops` after the first use the lower threshold."""
    out = [f"h0 AS (SELECT vec_id AS group_id, vec_id AS id, 1.0::double AS score, 0 AS hop FROM asked), g0 AS (SELECT * FROM h0)"]
    for h in range(1, hops + 1):
        out.append(f"h{h} AS (SELECT f.group_id, e.dst AS id, max(e.score) AS score, {h} AS hop FROM h{h - 1} f JOIN edges e ON e.src = f.id AND e.score >= {direct if h == 1 else rest} WHERE NOT EXISTS (SELECT 1 FROM g{h - 1} g WHERE g.group_id = f.group_id AND g.id = e.dst) GROUP BY f.group_id, e.dst), g{h} AS (SELECT * FROM g{h - 1} UNION ALL SELECT * FROM h{h})")
    return ", ".join(out)


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    # Normalizers
    out["normalize_text"] = f"SELECT doc_id, {n_text('text')} AS value FROM documents"
    out["tokenize"] = f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)"
    for f in ("name", "address", "phone", "email", "state", "zip"):
        out[f"normalize_{f}"] = with_(ENTS) + f"SELECT id, {NORMAL[f](f)} AS value FROM ents"
    out["normalize_name_compat"] = with_(ENTS) + f"SELECT id, {n_name('name', True)} AS value FROM ents"
    out["normalize_entity"] = with_(ENTS, NORM) + f"SELECT id, {', '.join(ALL_FIELDS)} FROM norm"
    out["combine_fields"] = with_(ENTS, NORM) + f"SELECT id, {COMBINED} AS combined FROM norm"
    out["entity_projection"] = with_(ENTS) + f"SELECT id, {', '.join(FIELDS)} FROM ents"
    # Comparators
    sims = {
        "sim_exact": lambda a, b: f"({a} = {b})::int::double",
        "sim_case_insensitive": lambda a, b: f"(lower({a}) = lower({b}))::int::double",
        "sim_levenshtein": levenshtein,
        "sim_jaccard": jaccard,
        "sim_token_cosine": token_cosine,
        "sim_contained_in": contained,
    }
    for key, fn in sims.items():
        out[key] = with_(ENTS, PAIRS) + f"SELECT id_a, id_b, round({fn('name_a', 'name_b')}, 6) AS score FROM pairs"
    out["sim_phone"] = with_(ENTS, PAIRS) + f"SELECT id_a, id_b, round({phone('phone_a', 'phone_b')}, 6) AS score FROM pairs"
    out["sim_zip"] = with_(ENTS, PAIRS) + f"SELECT id_a, id_b, round({zipcode('zip_a', 'zip_b')}, 6) AS score FROM pairs"
    jn = jaro_ctes("SELECT name_a AS a, name_b AS b FROM pairs", "j")
    for key, col in (("sim_jaro", "jaro"), ("sim_jaro_winkler", "jw")):
        out[key] = with_(ENTS, PAIRS, jn, recursive=True) + f"SELECT id_a, id_b, round({col}, 6) AS score FROM pairs JOIN j ON a = name_a AND b = name_b"
    for key, make in (("sim_name", name_scores), ("sim_address", address_scores), ("sim_email", email_scores)):
        ctes, last = make()
        out[key] = with_(ENTS, PAIRS, *ctes, recursive=True) + f"SELECT id_a, id_b, round(score, 6) AS score FROM {last}"
    cases = " ".join(f"WHEN regexp_matches(lower(f), {q('|'.join(parts))}) THEN {q(n)}" for n, parts in NAME_PARTS)
    names = "name company_name business_id organization address street_1 phone telephone mobile cell fax email email_address zip postal_code city hotel notes".split()
    out["infer_similarity_fn"] = f"SELECT f AS field, CASE {cases} ELSE 'JaroWinkler' END AS fn FROM (SELECT unnest([{', '.join(map(q, names))}]) AS f)"
    # Vectors
    out["vector_cosine"] = with_(ASKED, SCORES) + "SELECT query_id, id, round(score, 6) AS score FROM scores"
    out["vector_topk"] = with_("asked AS (SELECT * FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))", SCORES, RANKED) + "SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"
    out["vector_topk_per_query"] = with_(ASKED, SCORES, RANKED) + "SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"
    out["threshold_filter"] = with_(ASKED, SCORES, RANKED) + "SELECT query_id, id, round(score, 6) AS score FROM ranked WHERE rank <= 20 AND score >= 0.3"
    out["block_filtered_search"] = with_(ASKED, SCORES, "inside AS (SELECT * FROM scores WHERE q_label = label)", RANKED.replace("FROM scores", "FROM inside")) + "SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"
    out["vector_match_explain"] = with_(ASKED, SCORES, RANKED) + "SELECT query_id, id, round(score, 6) AS score, round(score, 6) AS vector_score, CASE WHEN score >= 0.75 THEN 'vector' ELSE '' END AS matched_on, round(score, 2) AS explained FROM ranked WHERE rank <= 10 AND score >= 0.3"
    out["vector_dim_check"] = "SELECT vec_id, embedding IS NOT NULL AND len(embedding) = 64 AS valid FROM embeddings"
    out["mock_embedding"] = with_(ENTS) + "SELECT id, i AS dim, round(CASE WHEN i < strlen(name) THEN ascii(name[i + 1])::double / 255.0 ELSE 0.0 END, 6) AS value FROM ents, (SELECT unnest(range(0, 16)) AS i)"
    # Blocking
    out["blocking_key"] = with_(ENTS, NORM, BLOCKED) + "SELECT id, cluster_id FROM blocked"
    out["recompute_clusters"] = out["blocking_key"]
    out["block_sizes"] = with_(ENTS, NORM, BLOCKED) + "SELECT cluster_id, count(*) AS block_size FROM blocked GROUP BY cluster_id"
    out["block_candidate_pairs"] = with_(ENTS, NORM, BLOCKED) + "SELECT x.cluster_id, x.id AS id_a, y.id AS id_b FROM blocked x JOIN blocked y ON x.cluster_id = y.cluster_id AND x.id < y.id WHERE x.cluster_id <> 'default'"
    # Matching
    vec = VECTOR_OF_NAME.format("text")
    prepared = [ENTS, NORM, BLOCKED, f"texts AS (SELECT *, {COMBINED} AS text FROM blocked)", f"ready AS (SELECT *, {vec} AS vector FROM texts)"]
    out["ingest_pipeline"] = with_(*prepared) + f"SELECT id, {', '.join(ALL_FIELDS)}, cluster_id, text, round(list_sum(list_transform(vector, lambda x: x::double)), 6) AS vector_sum, 0::BIGINT AS created_at, 0::BIGINT AS updated_at FROM ready"
    pair_scores = f"found AS (SELECT q.id AS query_id, e.id, {cos('q.vector', 'e.vector')} AS score, e.name FROM queries q, ready e WHERE {{where}})"
    best = "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM found)"
    out["match_text"] = with_(*prepared, f"queries AS (SELECT item_id AS id, {VECTOR_OF_NAME.format('text')} AS vector FROM benchmark)", pair_scores.format(where="true"), best) + "SELECT query_id, id, rank, round(score, 6) AS score FROM best WHERE rank <= 10 AND score >= 0.9"
    out["match_entity"] = with_(*prepared, "queries AS (SELECT * FROM ready WHERE CAST(substr(id, 2) AS INT) % 50 = 0)", pair_scores.format(where="q.cluster_id = e.cluster_id"), best) + "SELECT query_id, id, rank, round(score, 6) AS score FROM best WHERE rank <= 10 AND score >= 0.85"
    out["match_topk_ranked"] = with_(*prepared, "queries AS (SELECT * FROM ready WHERE CAST(substr(id, 2) AS INT) % 50 = 0)", pair_scores.format(where="true"), best) + "SELECT query_id, id, rank, round(score, 6) AS score FROM best WHERE rank <= 5"
    conf = "CASE WHEN score >= 0.9 THEN 'high' WHEN score < 0.7 THEN 'low' ELSE 'medium' END"
    on = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} <> '' THEN {q(f)} ELSE '' END" for f in sorted(FIELDS)) + "], lambda x: x <> ''), ', ')"
    out["matched_on"] = with_(ENTS) + f"SELECT id, {on} AS matched_on FROM ents"
    out["match_explanation"] = with_(ENTS, PAIRS, "explained AS (SELECT p.id_a, p.id_b, e.*, " + jaccard("p.name_a", "p.name_b") + " AS score FROM pairs p JOIN ents e ON e.id = p.id_b)") + f"SELECT id_a, id_b, concat('Matched with ', {conf}, ' confidence on fields: ', {on}) AS explanation FROM explained"
    out["parse_query_fields"] = """WITH texts AS (SELECT c_custkey AS id, concat('name = ', c_name, CASE c_custkey % 3 WHEN 0 THEN ';' ELSE ',' END, ' segment=', c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN ';' ELSE ',' END, CASE c_custkey % 2 WHEN 0 THEN 'name=again' ELSE 'broken' END) AS t FROM customer)
SELECT id, 'name' AS field, CASE id % 2 WHEN 0 THEN 'again' ELSE split_part(regexp_replace(t, '^name = ', ''), CASE id % 3 WHEN 0 THEN ';' ELSE ',' END, 1) END AS value FROM texts
UNION ALL SELECT id, 'segment', trim(regexp_extract(t, 'segment=([^;,]*)', 1)) FROM texts"""
    ctes, joins = all_scores()
    scored = ", ".join(f"round({SCORED[f]}, 6) AS score_{f}" for f in FIELDS)
    out["field_scores"] = with_(ENTS, PAIRS, *ctes, recursive=True) + f"SELECT p.id_a, p.id_b, {scored} FROM {joins}"
    out["weighted_score"] = with_(ENTS, PAIRS, *ctes, recursive=True) + f"SELECT p.id_a, p.id_b, round({WEIGHTED}, 6) AS score FROM {joins}"
    va, vb = (VECTOR_OF_NAME.format(f"p.name_{s}") for s in "ab")
    out["blended_score"] = with_(ENTS, PAIRS, *ctes, recursive=True) + f"SELECT p.id_a, p.id_b, round(({cos(va, vb)} + {WEIGHTED}) / 2, 6) AS score FROM {joins}"
    ctes, joins = all_scores(exact_name=True)
    out["field_scores_exact_override"] = with_(ENTS, PAIRS, *ctes, recursive=True) + f"SELECT p.id_a, p.id_b, {scored} FROM {joins}"
    # Groups
    for key, a, b, hops in (("group_direct", 0.3, 0.3, 1), ("group_transitive", 0.3, 0.3, 3)):
        out[key] = with_(ASKED, EDGES, group_ctes(a, b, hops)) + f"SELECT group_id, id, round(score, 6) AS score, hop AS hop_distance FROM g{hops}"
    # Walks start anew at the direct members, so they may pass the seed.
    from_direct = group_ctes(0.3, 0.3, 2).replace("SELECT vec_id AS group_id, vec_id AS id, 1.0::double AS score, 0 AS hop FROM asked", "SELECT d.vec_id AS group_id, e.dst AS id, e.score, 0 AS hop FROM asked d JOIN edges e ON e.src = d.vec_id AND e.score >= 0.35")
    out["group_hybrid"] = with_(ASKED, EDGES, from_direct) + "SELECT vec_id AS group_id, vec_id AS id, 1.0::DOUBLE AS score, 0 AS hop_distance FROM asked UNION ALL SELECT group_id, id, round(score, 6), hop + 1 FROM g2 WHERE id <> group_id"
    out["group_capped"] = with_(ASKED, EDGES, group_ctes(0.3, 0.3, 3)) + "SELECT group_id, id, round(score, 6) AS score, hop AS hop_distance FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY hop, score DESC, id) AS n FROM g3) WHERE n <= 8"
    out["group_stats"] = with_(ASKED, EDGES, group_ctes(0.3, 0.3, 3)) + "SELECT group_id, round(avg(score), 6) AS score, count(*) AS size FROM g3 GROUP BY group_id"
    block_groups = [ENTS, NORM, BLOCKED, "members AS (SELECT cluster_id AS group_id, id, 1.0::double AS score FROM blocked)"]
    long = "long AS (" + " UNION ALL ".join(f"SELECT cluster_id AS group_id, {q(f)} AS field, {f} AS value FROM blocked WHERE {f} <> ''" for f in ALL_FIELDS) + ")"
    counted = "counted AS (SELECT group_id, field, value, count(*) AS n FROM long GROUP BY ALL)"
    mode = "modes AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY n DESC, value) AS r FROM counted)"
    sizes = "sizes AS (SELECT cluster_id AS group_id, count(*) AS size FROM blocked GROUP BY cluster_id)"
    out["field_value_counts"] = with_(*block_groups, long, counted) + "SELECT group_id, field, value, n AS count FROM counted"
    out["field_agreement"] = with_(*block_groups, long, counted, mode, sizes) + "SELECT group_id, field, value, round(n::double / size, 6) AS agreement, round(n::double / size, 6) AS confidence FROM modes JOIN sizes USING (group_id) WHERE r = 1"
    gold = ", ".join(f"max(CASE WHEN field = {q(f)} THEN value END) AS {f}" for f in FIELDS)
    out["golden_record"] = with_(*block_groups, long, counted, mode) + f"SELECT group_id, {gold} FROM modes WHERE r = 1 GROUP BY group_id"
    out["all_components"] = with_(EDGES.replace("x.vec_id <> y.vec_id", "x.vec_id > y.vec_id"), "walk AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.src, w.root FROM walk w JOIN (SELECT src, dst FROM edges WHERE score >= 0.35 UNION ALL SELECT dst, src FROM edges WHERE score >= 0.35) e ON e.dst = w.id)", recursive=True) + "SELECT id, min(root) AS component FROM walk GROUP BY id HAVING count(*) > 1"
    # Store
    out["entity_count"] = with_(ENTS) + "SELECT count(*) AS entities FROM ents"
    out["entity_get"] = with_(ENTS) + "SELECT * FROM ents WHERE id = 'a00000007'"
    out["entity_lookup"] = with_(ENTS) + "SELECT e.* FROM ents e JOIN (SELECT concat('a', lpad(CAST(o_custkey AS STRING), 8, '0')) AS id, count(*) AS n FROM orders GROUP BY 1) o ON o.id = e.id"
    out["entity_list_page"] = with_(ENTS) + "SELECT id, name FROM ents ORDER BY id LIMIT 100 OFFSET 50"
    out["entity_update"] = with_(ENTS) + "SELECT e.id, coalesce(u.name, e.name) AS name, coalesce(u.zip, e.zip) AS zip, e.phone FROM ents e LEFT JOIN (SELECT concat('a', substr(id, 2)) AS id, name, zip FROM ents WHERE id LIKE 'b%') u ON u.id = e.id"
    twins = "twins AS (SELECT substr(id, 2) AS k, name, zip FROM ents WHERE id LIKE 'b%')"
    even = "FROM twins WHERE CAST(k AS INT) % 2 = 0"
    out["entity_upsert"] = with_(ENTS, twins) + f"""SELECT id, name, zip, phone FROM ents WHERE id NOT IN (SELECT concat('a', k) FROM twins)
UNION ALL SELECT concat('a', k), name, zip, NULL FROM twins UNION ALL SELECT concat('c', k), name, zip, NULL {even}
UNION ALL SELECT DISTINCT 'new', name, zip, NULL {even} AND k LIKE '%2'"""
    out["entity_delete"] = with_(ENTS) + "SELECT id, name FROM ents WHERE id NOT LIKE 'b%'"
    # JSON
    out["json_entities"] = with_(ENTS) + f"SELECT id, {', '.join(FIELDS)}, 'view' AS source FROM ents"
    fields_m = ", ".join(f"m.{f}" for f in FIELDS)
    on_m = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN m.{f} <> '' THEN {q(f)} ELSE '' END" for f in sorted(FIELDS)) + "], lambda x: x <> ''), '{0}')"
    found = [*prepared, "queries AS (SELECT * FROM ready WHERE CAST(substr(id, 2) AS INT) % 50 = 0)", pair_scores.format(where="q.cluster_id = e.cluster_id"), best]
    joined = "FROM best b JOIN ents m ON m.id = b.id JOIN ents q ON q.id = b.query_id WHERE rank <= 3 AND score >= 0.85"
    out["match_projection"] = with_(*found) + f"SELECT query_id, b.id, rank, round(score, 6) AS score, round(score, 6) AS vector_score, {on_m.format(',')} AS matched_on, concat('Matched with ', {conf}, ' confidence (', printf('%.2f', score), ') on fields: ', {on_m.format(', ')}) AS explanation, {fields_m}, CASE WHEN q.phone <> '' THEN (q.phone = m.phone)::int::double END AS score_phone, CASE WHEN q.zip <> '' THEN round({zipcode('q.zip', 'm.zip')}, 6) END AS score_zip {joined}"
    out["json_matches"] = with_(*found) + f"SELECT query_id, b.id, rank, {on_m.format(',')} AS matched_on {joined}"
    out["json_groups"] = with_(*block_groups, long, counted, mode, sizes) + "SELECT group_id, size, ids, value AS name, round(n::double / size, 6) AS agreement FROM modes JOIN sizes USING (group_id) JOIN (SELECT group_id, string_agg(id, ',' ORDER BY id) AS ids FROM members GROUP BY group_id) USING (group_id) WHERE r = 1 AND field = 'name'"
    # Registry and options
    listed = lambda kind, table: [f"({q(kind)}, {q(a.upper())}, {q(n)})" for n, xs in table.items() for a in xs.split()] + [f"({q(kind)}, 'UNKNOWN', 'JaroWinkler')"]
    out["similarity_registry"] = f"SELECT * FROM (VALUES {', '.join(listed('name', ALIASES) + listed('type', FIELD_TYPES))}) t(kind, alias, fn)"
    out["field_scores_self"] = with_(ENTS, PAIRS) + "SELECT id_a, id_b, " + ", ".join(f"CASE WHEN {f}_b <> '' THEN 1.0::DOUBLE END AS score_{f}" for f in FIELDS) + " FROM pairs"
    typed = {"city": phone, "state": zipcode, "zip": phone}
    out["field_scores_by_type"] = with_(ENTS, PAIRS) + "SELECT id_a, id_b, " + ", ".join(f"CASE WHEN {f}_a <> '' THEN round({fn(f'{f}_a', f'{f}_b')}, 6) END AS score_{f}" for f, fn in typed.items()) + " FROM pairs"
    out["filter_conjunction_search"] = with_(ASKED, SCORES, "inside AS (SELECT * FROM scores WHERE q_label = label AND query_id % 2 = id % 2)", RANKED.replace("FROM scores", "FROM inside")) + "SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"
    return out
