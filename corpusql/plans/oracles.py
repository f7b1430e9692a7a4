"""DuckDB SQL oracles, one per registered query key.

Each oracle re-derives its fixture inputs from the pre-registered views with
the same deterministic rules as ``fixtures.py`` and recomputes the operator in
plain SQL (joins, window functions, ``string_agg``), independently of the Spark
formulation. Scored predictions come from fixed templates and variants, so their
execution verdicts are computed by running every template beside its variants.
"""

from __future__ import annotations

from corpusql.functions import prompts as P
from corpusql.functions.sqltext import SQL_TOKEN_PATTERN
from corpusql.plans import fixtures as fx

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_lit(s: str) -> str:
    """String literal that may contain newlines (joined with chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join(lit(p) for p in parts) if len(parts) > 1 else lit(s)


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize(x: str) -> str:
    toks = f"regexp_extract_all({x}, {lit(SQL_TOKEN_PATTERN)})"
    mapped = (f"list_transform({toks}, lambda t: CASE WHEN regexp_matches(t, '^[''\"`]') THEN t "
              f"WHEN starts_with(t, '--') OR starts_with(t, '/*') THEN ' ' ELSE lower(t) END)")
    joined = f"array_to_string({mapped}, '')"
    return f"trim(regexp_replace(regexp_replace({joined}, '[\\s;]+$', ''), '\\s+', ' ', 'g'))"


KEY = "(doc_id + doc_id // 10)"
GOLD = "[" + ", ".join(lit(t) for t in fx.GOLD_TEMPLATES) + f"][{KEY} % {len(fx.GOLD_TEMPLATES)} + 1]"
PERTURB = ("[" + ", ".join(text_lit(t) for t in fx.PREDICTED)
           + f"][({KEY} % {len(fx.GOLD_TEMPLATES)}) * {fx.N_VARIANTS} + {KEY} % {fx.N_VARIANTS} + 1]")
RAW_TYPES = "[" + ", ".join(lit(t) for t in fx.RAW_TYPES) + "]"
K = "(1 + n_chars % 6)"
T_ = "(1 + doc_id % 3)"

CTE_RAW = f"""raw AS (
  SELECT source AS db_id, text AS question, {GOLD} AS query, doc_id AS pos
  FROM documents)"""

CTE_CATALOG = f"""catalog AS (
  SELECT source AS db_id,
    list_transform(range(0, {T_}), lambda i: lang || '_t' || CAST(i AS VARCHAR)) AS table_names_original,
    list_concat([['-1', '*']], list_transform(range(0, {K}),
        lambda j: [CAST(j % {T_} AS VARCHAR), 'c' || CAST(j AS VARCHAR)])) AS column_names_original,
    list_concat(['text'], list_transform(range(0, {K}), lambda j: {RAW_TYPES}[(doc_id + j) % 6 + 1])) AS column_types,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 AND {K} >= 2 THEN ['1', '2'] ELSE ['1'] END AS primary_keys,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE list_filter([
        CASE WHEN {K} >= 2 THEN [CAST({K} AS INTEGER), 1] END,
        CASE WHEN {K} >= 3 AND doc_id % 7 = 0 THEN [CAST({K} AS INTEGER), 2] END,
        CASE WHEN {K} >= 2 AND doc_id % 13 = 0 THEN [2, 0] END], lambda x: x IS NOT NULL) END AS foreign_keys,
    doc_id AS pos
  FROM documents WHERE source NOT LIKE '%7')"""

CTE_COLS = """c0 AS (
  SELECT db_id, pos, table_names_original AS tn, primary_keys AS pk, column_names_original AS cn,
         column_types AS ct, unnest(range(0, len(column_names_original))) AS idx
  FROM catalog),
cols AS (
  SELECT db_id, pos, CAST(idx AS INTEGER) AS idx, TRY_CAST(cn[idx + 1][1] AS INTEGER) AS t,
         cn[idx + 1][2] AS name, ct[idx + 1] AS raw_type,
         tn[TRY_CAST(cn[idx + 1][1] AS INTEGER) + 1] AS table_name,
         CASE ct[idx + 1] WHEN 'text' THEN 'TEXT' WHEN 'number' THEN 'INTEGER' WHEN 'time' THEN 'TEXT'
              WHEN 'boolean' THEN 'INTEGER' WHEN 'others' THEN 'TEXT' ELSE 'TEXT' END AS sql_type,
         list_contains(coalesce(list_transform(pk, lambda x: TRY_CAST(x AS INTEGER)), []), CAST(idx AS INTEGER)) AS is_pk
  FROM c0
  WHERE TRY_CAST(cn[idx + 1][1] AS INTEGER) >= 0 AND TRY_CAST(cn[idx + 1][1] AS INTEGER) < len(tn)),
f0 AS (
  SELECT db_id, pos, foreign_keys AS fk, unnest(range(0, len(coalesce(foreign_keys, [])))) AS fi FROM catalog),
fv AS (
  SELECT f0.db_id, f0.pos, f0.fi, c.idx AS child_idx, c.table_name AS child_table, c.name AS child_column,
         p.idx AS parent_idx, p.table_name AS ref_table, p.name AS ref_column
  FROM f0 JOIN cols c ON c.pos = f0.pos AND c.idx = f0.fk[f0.fi + 1][1]
          JOIN cols p ON p.pos = f0.pos AND p.idx = f0.fk[f0.fi + 1][2]),
flast AS (
  SELECT * FROM fv QUALIFY row_number() OVER (PARTITION BY pos, child_idx ORDER BY fi DESC) = 1)"""

CTE_DDL = CTE_COLS + f""",
lines AS (
  SELECT pos, t, table_name, 0 AS kind, idx,
         '  ' || name || ' ' || sql_type || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END AS line
  FROM cols
  UNION ALL
  SELECT c.pos, c.t, c.table_name, 1, c.idx,
         '  FOREIGN KEY (' || c.name || ') REFERENCES ' || f.ref_table || '(' || f.ref_column || ')'
  FROM cols c JOIN flast f ON f.pos = c.pos AND f.child_idx = c.idx),
tbl AS (
  SELECT pos, t, 'CREATE TABLE ' || any_value(table_name) || ' (' || {NL}
         || string_agg(line, ',' || {NL} ORDER BY kind, idx) || {NL} || ');' AS stmt
  FROM lines GROUP BY pos, t),
ddl AS (
  SELECT c.db_id, c.pos, coalesce(string_agg(tbl.stmt, {NL} || {NL} ORDER BY tbl.t), '') AS schema
  FROM catalog c LEFT JOIN tbl ON tbl.pos = c.pos GROUP BY c.db_id, c.pos),
lookup AS (SELECT db_id, arg_max(schema, pos) AS schema FROM ddl GROUP BY db_id)"""

CTE_EXAMPLES = ",\n".join([CTE_RAW, CTE_CATALOG, CTE_DDL, f"""examples AS (
  SELECT {lit(P.INSTRUCTION_TEXT)} AS instruction, l.schema, r.question, r.query AS output, r.db_id, r.pos
  FROM raw r JOIN lookup l ON l.db_id = r.db_id)"""])

CTE_SPLITS = CTE_EXAMPLES + f""",
tf AS (SELECT * FROM examples WHERE pos % 10 <> 0),
ids AS (SELECT DISTINCT db_id FROM tf),
nval AS (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE least(count(*), greatest(1,
           CAST(floor(count(*) * CAST({fx.VAL_RATIO} AS DOUBLE)) AS BIGINT))) END AS n FROM ids),
ranked AS (SELECT db_id, row_number() OVER (ORDER BY md5('{fx.SEED}:' || db_id), db_id) AS rk FROM ids),
splits AS (
  SELECT tf.*, CASE WHEN rk <= (SELECT n FROM nval) THEN 'val' ELSE 'train' END AS split
  FROM tf JOIN ranked USING (db_id)
  UNION ALL SELECT *, 'dev' AS split FROM examples WHERE pos % 10 = 0),
test AS (SELECT *, pos // 10 AS "index" FROM examples WHERE pos % 10 = 0),
train AS (SELECT * FROM splits WHERE split = 'train')"""

HASH_DRAW = ("CAST('0x' || substr(md5('{seed}:' || CAST({a} AS VARCHAR) || ':' || CAST({b} AS VARCHAR)), 1, 12) AS BIGINT)")

CTE_PICKS = CTE_SPLITS + f""",
tr AS (SELECT *, row_number() OVER (ORDER BY length(schema), db_id, pos) - 1 AS g FROM train),
st AS (SELECT db_id, min(g) AS s, count(*) AS n FROM tr GROUP BY db_id),
t0 AS (
  SELECT te."index", te.db_id,
         CASE WHEN te.db_id IS NULL OR te.db_id = '' THEN 0 ELSE coalesce(st.n, 0) END AS nx,
         coalesce(st.s, 0) AS sx
  FROM test te LEFT JOIN st ON st.db_id = te.db_id),
t1 AS (SELECT *, (SELECT count(*) FROM tr) - nx AS c FROM t0),
t2 AS (SELECT *, CASE WHEN c // 2 < {fx.FEW_SHOT_K} THEN c ELSE c // 2 END AS pool FROM t1),
t3 AS (SELECT *, least({fx.FEW_SHOT_K}, pool) AS m FROM t2),
draws AS (
  SELECT "index", nx, sx,
    CASE WHEN m > 0 THEN list_reduce(range(pool - m, pool), lambda acc, j:
      CASE WHEN list_contains(acc, {HASH_DRAW.format(seed=fx.SEED, a='"index"', b='j')} % (j + 1))
           THEN list_append(acc, j)
           ELSE list_append(acc, {HASH_DRAW.format(seed=fx.SEED, a='"index"', b='j')} % (j + 1)) END,
      []::BIGINT[]) ELSE []::BIGINT[] END AS picks
  FROM t3),
ex AS (SELECT "index", nx, sx, unnest(picks) AS p FROM draws),
slots AS (
  SELECT "index", row_number() OVER (PARTITION BY "index" ORDER BY md5('{fx.SEED}:' || CAST("index" AS VARCHAR) || ':' || CAST(p AS VARCHAR)), p) AS slot,
         CASE WHEN p < sx THEN p ELSE p + nx END AS g
  FROM ex),
picks AS (
  SELECT s."index", s.slot, s.g, tr.pos AS pick_pos, tr.db_id AS pick_db_id, tr.schema, tr.question, tr.output
  FROM slots s JOIN tr ON tr.g = s.g)"""

RESP = (f"""CASE {KEY} % 6
      WHEN 0 THEN '```sql' || {NL} || pred || {NL} || '```'
      WHEN 1 THEN 'Here is the query:' || {NL} || '```' || {NL} || pred || {NL} || '```' || {NL} || 'It answers the question.'
      WHEN 2 THEN pred || ';' || {NL} || {NL} || 'This query ' || text
      WHEN 3 THEN 'Answer for ' || source || ':' || {NL} || pred
      WHEN 4 THEN '```sqlite' || {NL} || pred || {NL} || '```'
      ELSE 'The query is ' || pred END""")

CTE_RESPONSES = f"""d0 AS (SELECT *, {GOLD} AS g FROM documents),
d1 AS (SELECT *, {PERTURB} AS pred FROM d0),
responses AS (
  SELECT 'zero-shot' AS mode, doc_id AS "index", {RESP} AS response,
         CAST(n_chars % 900 AS DOUBLE) / 100.0 AS generation_time_s, doc_id AS pos
  FROM d1)"""

KW = "^(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE)"
FENCE = "(?is)```(?:sql)?\\s*\\n?(.*?)```"
CTE_EXTRACT = CTE_RESPONSES + f""",
r0 AS (SELECT "index", {py_strip('response')} AS r FROM responses),
r1 AS (SELECT "index", r,
         list_filter(list_transform(string_split(r, {NL}), lambda l: {py_strip('l')}),
                     lambda l: regexp_matches(upper(l), '{KW}')) AS sql_lines FROM r0),
extracted AS (
  SELECT "index",
    CASE WHEN regexp_matches(r, {lit(FENCE)}) THEN {py_strip(f"regexp_extract(r, {lit(FENCE)}, 1)")}
         WHEN regexp_matches(upper(r), '{KW}') THEN {py_strip("regexp_extract(r, '(?s)^(.*?)(?:;|' || chr(10) || chr(10) || '|$)', 1)")}
         WHEN len(sql_lines) > 0 THEN {py_strip("regexp_replace(sql_lines[1], ';+$', '')")}
         ELSE r END AS pred_sql,
    CASE WHEN regexp_matches(r, {lit(FENCE)}) THEN 'fenced_block'
         WHEN regexp_matches(upper(r), '{KW}') THEN 'leading_keyword'
         WHEN len(sql_lines) > 0 THEN 'keyword_line' ELSE 'whole_text' END AS strategy
  FROM r1)"""

CTE_PAIRS = f"""d0 AS (SELECT *, {GOLD} AS g FROM documents),
pairs AS (SELECT doc_id AS pos, g AS gold_sql, {PERTURB} AS pred_sql FROM d0)"""

CTE_EVENTS = """ev AS (
  SELECT event_type AS mode, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS "index",
         event_id, ts, CAST(user_id AS VARCHAR) AS db_id, props AS question,
         value > 60 AS exact_match, value > 25 AS exec_match,
         CASE WHEN value < 2 THEN 'invalid: ' || event_type END AS pred_error,
         value AS generation_time_s, user_id % 50 <> 0 AS db_found
  FROM events)"""

METRICS_SELECT = """SELECT mode, count(*) AS total_examples,
  CAST(count(*) FILTER (WHERE exact_match) AS DOUBLE) * 100.0 / count(*) AS exact_match_accuracy,
  CAST(count(*) FILTER (WHERE exec_match) AS DOUBLE) * 100.0 / count(*) AS execution_accuracy,
  count(*) FILTER (WHERE exact_match) AS exact_match_count,
  count(*) FILTER (WHERE exec_match) AS execution_match_count,
  count(*) FILTER (WHERE pred_error IS NOT NULL AND db_found) AS execution_error_count,
  CAST(count(*) FILTER (WHERE pred_error IS NOT NULL AND db_found) AS DOUBLE) * 100.0 / count(*) AS error_rate,
  CAST(sum(CAST(generation_time_s AS DECIMAL(20, 2))) AS DOUBLE) / count(*) AS avg_generation_time_s
FROM {src} GROUP BY mode"""

CTE_TOKENS = f"""tok AS (
  SELECT doc_id AS pos,
         list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'),
                        lambda w: CAST(unicode(w) + 256 * length(w) AS INTEGER)) AS input_ids
  FROM documents),
feat AS (
  SELECT pos, input_ids,
         CASE WHEN pos % 3 = 0 THEN NULL ELSE list_transform(input_ids, lambda x: 1) END AS attention_mask,
         CASE WHEN pos % 4 = 0 THEN NULL ELSE input_ids END AS labels
  FROM tok),
deff AS (
  SELECT pos, input_ids, coalesce(attention_mask, list_transform(input_ids, lambda x: 1)) AS attention_mask,
         coalesce(labels, input_ids) AS labels FROM feat),
bm AS (SELECT *, pos // {fx.BATCH_SIZE} AS batch, max(len(input_ids)) OVER (PARTITION BY pos // {fx.BATCH_SIZE}) AS m FROM deff),
padded AS (
  SELECT pos, batch,
         list_concat(input_ids, list_transform(range(m - len(input_ids)), lambda x: 0)) AS input_ids,
         list_concat(attention_mask, list_transform(range(m - len(input_ids)), lambda x: 0)) AS attention_mask,
         list_concat(labels, list_transform(range(m - len(input_ids)), lambda x: -100)) AS labels
  FROM bm)"""

TMPL = "[" + ", ".join(str(t) for t in fx.TOKEN_TEMPLATE) + "]"
L = len(fx.TOKEN_TEMPLATE)

# ------------------------------------------------------------------ execution pairs
# Number of output columns of each distinct execution text (fixture metadata) and
# the texts Spark rejects (analysis/parse errors): the oracle cannot run those.
FAILING_TEXTS = {"SELECT s_nme FROM supplier", "SELECT count(*) FROM lineitems", "DELETE FROM nation", "nation",
                 "SELECT 1 AS a) UNION ALL (SELECT 2", "SELECT reflect('java.lang.System', 'currentTimeMillis')",
                 "SELECT count(*) FROM parquet.`/tmp`"}
MISSING_DBS = {"src3"}


def _ncols(sql: str) -> int:
    head = sql.split(" FROM ")[0]
    depth, n = 0, 1
    for ch in head:
        depth += ch == "("
        depth -= ch == ")"
        n += ch == "," and depth == 0
    return n


def _exec_text(sql: str) -> str:
    return sql.strip().rstrip("; \n")


def _strrows(sql: str, sign: int, n: int | None = None) -> str:
    n = n or _ncols(sql)
    cols = ", ".join(f"c{i}" for i in range(n))
    vals = ", ".join(f"coalesce(CAST(c{i} AS VARCHAR), 'None')" for i in range(n))
    return f"SELECT [{vals}] AS r, {sign} AS s FROM ({sql}) AS q({cols})"


def _pair_row(eid, db, gold, pred) -> str:
    g, p = _exec_text(gold), _exec_text(pred)
    if db in MISSING_DBS:
        return (f"SELECT {eid} AS example_id, {lit(db)} AS db_id, false AS exec_match, -1 AS gold_rows, "
                f"-1 AS pred_rows, true AS gold_failed, true AS pred_failed, false AS db_found")
    grows = f"(SELECT count(*) FROM ({g}))"
    if p in FAILING_TEXTS:
        return (f"SELECT {eid} AS example_id, {lit(db)} AS db_id, false AS exec_match, {grows} AS gold_rows, "
                f"-1 AS pred_rows, false AS gold_failed, true AS pred_failed, true AS db_found")
    prows = f"(SELECT count(*) FROM ({p}))"
    same = (f"(SELECT count(*) = 0 FROM (SELECT r FROM ({_strrows(g, 1)} UNION ALL {_strrows(p, -1)}) "
            f"GROUP BY r HAVING sum(s) <> 0))")
    return (f"SELECT {eid} AS example_id, {lit(db)} AS db_id, {same} AS exec_match, {grows} AS gold_rows, "
            f"{prows} AS pred_rows, false AS gold_failed, false AS pred_failed, true AS db_found")


N_CASES = 40     # template and variant of a document follow from its key modulo 40


def _variants() -> str:
    """``(k, gold, pred, gold_rows, pred_rows, same)`` per template and variant that occur together; pred_rows
    is -1 where Spark rejects the text."""
    rows = []
    for k in range(N_CASES):
        t, v = k % len(fx.GOLD_TEMPLATES), k % fx.N_VARIANTS
        gold, pred = _exec_text(fx.GOLD_TEMPLATES[t]), _exec_text(fx.PREDICTED[t * fx.N_VARIANTS + v])
        n = _ncols(gold)
        fails = v in FAILING_VARIANTS or not pred
        same = "false" if fails else (f"(SELECT count(*) = 0 FROM (SELECT r FROM ({_strrows(gold, 1, n)} UNION ALL "
                                      f"{_strrows(pred + chr(10), -1, 1 if v == 6 else n)}) GROUP BY r HAVING sum(s) <> 0))")
        rows.append(f"SELECT {k} AS k, {text_lit(gold)} AS gold, {text_lit(pred)} AS pred, (SELECT count(*) FROM ({gold})) AS gold_rows, "
                    + ("-1" if fails else f"(SELECT count(*) FROM ({pred + chr(10)}))") + f" AS pred_rows, {same} AS same")
    return "\nUNION ALL ".join(rows)


def _execution_accuracy_sql() -> str:
    rows = "\nUNION ALL ".join(_pair_row(*p) for p in fx.EXECUTION_PAIRS)
    return f"""WITH variants AS ({_variants()}),
examples AS (SELECT doc_id + 100 AS example_id, source AS db_id, {KEY} % {N_CASES} AS k, source NOT LIKE '%3' AS found FROM documents)
SELECT example_id, db_id, exec_match, CAST(gold_rows AS BIGINT) AS gold_rows, CAST(pred_rows AS BIGINT) AS pred_rows,
       gold_failed, pred_failed, db_found FROM (
{rows}
UNION ALL SELECT example_id, db_id, found AND same, CASE WHEN found THEN gold_rows ELSE -1 END, CASE WHEN found THEN pred_rows ELSE -1 END,
       NOT found, NOT found OR pred_rows < 0, found FROM examples JOIN variants USING (k))"""


def _execute_queries_sql() -> str:
    texts: dict[str, str] = {}
    used = []
    for _, db, gold, pred in fx.EXECUTION_PAIRS:
        for text in map(_exec_text, (gold, pred)):
            used.append(f"({lit(db)}, {lit(text)})")
            texts[text] = "-1" if text in FAILING_TEXTS else f"(SELECT count(*) FROM ({text}))"
    rows = "\nUNION ALL ".join(f"SELECT {lit(text)} AS text, {n} AS n" for text, n in sorted(texts.items()))
    return f"""WITH variants AS ({_variants()}),
used AS (SELECT * FROM (VALUES {', '.join(used)}) x(db_id, text)
  UNION ALL SELECT source, gold FROM documents JOIN variants ON k = {KEY} % {N_CASES}
  UNION ALL SELECT source, pred FROM documents JOIN variants ON k = {KEY} % {N_CASES}),
counted AS (SELECT text, any_value(n) AS n FROM ({rows} UNION ALL SELECT gold, gold_rows FROM variants UNION ALL SELECT pred, pred_rows FROM variants) GROUP BY text),
place AS (SELECT CASE WHEN db_id LIKE '%3' THEN db_id END AS gone, text, min(db_id) AS db_id FROM used GROUP BY ALL)
SELECT db_id, text AS exec_sql, gone IS NOT NULL OR n < 0 AS failed, CAST(CASE WHEN gone IS NULL THEN n ELSE -1 END AS BIGINT) AS n_rows
FROM place JOIN counted USING (text)"""


FAILING_VARIANTS = (5, 8)      # an unknown column; no SQL
FAILING_SHAPES = (4, 5)        # the text of a fence tagged 'sqlite' begins with 'ite'; prose before the SQL


def _variant_verdicts() -> str:
    """``(t, v, same)`` for every template and variant that occur together and run."""
    rows = []
    for k in range(40):
        t, v = k % len(fx.GOLD_TEMPLATES), k % fx.N_VARIANTS
        if v in FAILING_VARIANTS:
            continue
        gold, pred = fx.GOLD_TEMPLATES[t], fx.PREDICTED[t * fx.N_VARIANTS + v].rstrip("; \n")
        n = _ncols(gold)
        rows.append(f"SELECT {t} AS t, {v} AS v, (SELECT count(*) = 0 FROM (SELECT r FROM ({_strrows(gold, 1, n)} UNION ALL "
                    f"{_strrows(pred + chr(10), -1, 1 if v == 6 else n)}) GROUP BY r HAVING sum(s) <> 0)) AS same")
    return "\nUNION ALL ".join(rows)


def _records_cte() -> str:
    return f"""WITH {CTE_SPLITS},
{CTE_EXTRACT},
verdicts AS ({_variant_verdicts()}),
scored AS (
  SELECT te."index", te.db_id, te.output AS gold_sql, e.pred_sql, r.generation_time_s,
         {KEY.replace('doc_id', 'te.pos')} AS k, te.db_id NOT LIKE '%3' AS db_found
  FROM test te JOIN extracted e ON e."index" = te.pos JOIN responses r ON r.pos = te.pos),
records AS (
  SELECT 'zero-shot' AS mode, "index", k, db_id, gold_sql, pred_sql,
         coalesce({normalize('gold_sql')} = {normalize('pred_sql')}, false) AS exact_match,
         NOT db_found OR k % 6 IN {FAILING_SHAPES} OR k % 10 IN {FAILING_VARIANTS} AS pred_failed,
         k % 10 = 5 AND k % 6 NOT IN {FAILING_SHAPES} AS bad_name,
         db_found AND k % 6 NOT IN {FAILING_SHAPES} AND coalesce(v.same, false) AS exec_match,
         db_found, round(generation_time_s, 2) AS generation_time_s
  FROM scored LEFT JOIN verdicts v ON v.t = k % 8 AND v.v = k % 10)"""


def _word_list(x: str, pattern: str, case: str) -> str:
    return f"list_sort(regexp_extract_all({case}({x}), {lit(pattern)}, 1))"


def _error_buckets_sql() -> str:
    """Shapes of fixture texts by patterns, which these texts allow; a text that is no query has an empty one."""
    tables = lambda x: f"list_sort(list_distinct({_word_list(x, '(?:from|join)[ ]+([a-z_][a-z0-9_]*)', 'lower')}))"
    joins = lambda x: f"len(regexp_extract_all(upper({x}), '\\bJOIN\\b'))"
    aggs = lambda x: _word_list(x, r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\(", "upper")
    return _records_cte() + f""",
read AS (SELECT *, CASE WHEN k % 6 IN {FAILING_SHAPES} OR k % 10 = 8 THEN '' ELSE pred_sql END AS pred FROM records),
named AS (
  SELECT mode, "index", CASE WHEN db_found AND pred_failed AND bad_name THEN 'schema_misunderstanding'
         WHEN db_found AND pred_failed THEN 'invalid_sql'
         WHEN exec_match AND NOT exact_match THEN 'false_negative_exact_match'
         WHEN NOT db_found AND exact_match THEN 'other'
         WHEN {joins('gold_sql')} <> {joins('pred')} OR {tables('gold_sql')} <> {tables('pred')} THEN 'wrong_join'
         WHEN {aggs('gold_sql')} <> {aggs('pred')} THEN 'wrong_aggregation' ELSE 'other' END AS category
  FROM read WHERE NOT (exact_match AND exec_match))
SELECT mode, category, count(*) AS n_examples, list_sort(list("index"))[1:2] AS examples FROM named GROUP BY mode, category"""


def _feature_flags(q: str) -> str:
    flags = [("JOINS", f"contains({q}, 'JOIN')"),
             ("SUBQUERY", f"regexp_matches({q}, '(?s)FROM.*SELECT')"),
             ("AGGREGATION", " OR ".join(f"contains({q}, '{a}')" for a in ("COUNT(", "SUM(", "AVG(", "MAX(", "MIN("))),
             ("GROUP BY", f"contains({q}, 'GROUP BY')"), ("HAVING", f"contains({q}, 'HAVING')"),
             ("ORDER BY", f"contains({q}, 'ORDER BY')"),
             ("SET OPS", " OR ".join(f"contains({q}, '{w}')" for w in ("INTERSECT", "UNION", "EXCEPT"))),
             ("LIKE", f"contains({q}, 'LIKE')"), ("NESTED", f"regexp_matches({q}, '(?s)SELECT.*SELECT')")]
    arr = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in flags)
    return f"list_filter([{arr}], lambda x: x IS NOT NULL)"


def _feature_distribution() -> str:
    q = "upper(output)"
    conds = [("JOIN", f"contains({q}, 'JOIN')"),
             ("Aggregation", " OR ".join(f"contains({q}, '{a}')" for a in ("COUNT(", "SUM(", "AVG(", "MAX(", "MIN("))),
             ("GROUP BY", f"contains({q}, 'GROUP BY')"), ("HAVING", f"contains({q}, 'HAVING')"),
             ("ORDER BY", f"contains({q}, 'ORDER BY')"),
             ("Nested/Subquery", f"regexp_matches({q}, '(?s)SELECT.*SELECT')"),
             ("Set Operations", " OR ".join(f"contains({q}, '{w}')" for w in ("INTERSECT", "UNION", "EXCEPT"))),
             ("LIKE", f"contains({q}, 'LIKE')")]
    parts = "\nUNION ALL ".join(
        f"SELECT '{n}' AS feature, count(*) FILTER (WHERE {c}) AS n_examples, count(*) AS total FROM examples"
        for n, c in conds)
    return (f"WITH {CTE_EXAMPLES},\nd AS ({parts})\n"
            "SELECT feature, n_examples, CAST(n_examples AS DOUBLE) * 100.0 / total AS pct FROM d WHERE n_examples > 0")


def _len_stats(col: str, alias: str) -> str:
    return (f"min(length({col})) AS min_{alias}, max(length({col})) AS max_{alias}, "
            f"CAST(sum(length({col})) AS DOUBLE) / count(*) AS avg_{alias}")


WORDS = "len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> ''))"
ZERO_SHOT = (f"{text_lit(P.ZERO_SHOT_HEADER + chr(10) + chr(10) + 'Schema:' + chr(10))} || schema || "
             f"{text_lit(chr(10) + chr(10) + 'Question: ')} || question || {text_lit(chr(10) + chr(10) + 'SQL:')}")
TEMPLATE_PROMPT = (f"{text_lit(P.CONFIG_PROMPT_TEMPLATE.split('{schema}')[0])} || schema || "
                   f"{text_lit(P.CONFIG_PROMPT_TEMPLATE.split('{schema}')[1].split('{question}')[0])} || question || "
                   f"{text_lit(P.CONFIG_PROMPT_TEMPLATE.split('{question}')[1])}")


def _few_shot(header: str, block: str, tail: str) -> str:
    return f"""WITH {CTE_PICKS},
blocks AS (SELECT "index", string_agg({block}, {NL} ORDER BY slot) AS b FROM picks GROUP BY "index")
SELECT te."index", te.db_id,
       {text_lit(header)} || {NL} || coalesce(b.b || {NL}, '') || {tail} AS prompt
FROM test te LEFT JOIN blocks b ON b."index" = te."index\""""


FEW_SHOT_BLOCK = (f"{NL} || '### Example ' || CAST(slot AS VARCHAR) || {NL} || 'Schema:' || {NL} || schema || "
                  f"{NL} || {NL} || 'Question: ' || question || {NL} || {NL} || 'SQL: ' || output || {NL}")
FEW_SHOT_TAIL = (f"{NL} || '### Your Turn' || {NL} || 'Schema:' || {NL} || te.schema || {NL} || {NL} || "
                 f"'Question: ' || te.question || {NL} || {NL} || 'SQL:'")
SHARED_BLOCK = (f"'### Example ' || CAST(slot AS VARCHAR) || {NL} || {NL} || 'Schema:' || {NL} || schema || "
                f"{NL} || {NL} || 'Question: ' || question || {NL} || {NL} || 'SQL: ' || output || {NL}")
SHARED_TAIL = (f"'### Your Turn' || {NL} || {NL} || 'Schema:' || {NL} || te.schema || {NL} || {NL} || "
               f"'Question: ' || te.question || {NL} || {NL} || 'SQL:'")

LATENCY = """WITH r AS (SELECT event_type, value, row_number() OVER (ORDER BY event_type, value, event_id) - 1 AS g FROM events WHERE event_id % 4 <> 0),
s AS (SELECT event_type, min(g) AS s, count(*) AS n FROM r GROUP BY event_type),
w AS (SELECT event_type, s, n, p, CAST(n - 1 AS DOUBLE) * p AS rr
      FROM s, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) v(p)),
q AS (SELECT w.event_type, w.p, lo.value + (hi.value - lo.value) * (w.rr - floor(w.rr)) AS q
      FROM w JOIN r lo ON lo.g = w.s + CAST(floor(w.rr) AS BIGINT)
             JOIN r hi ON hi.g = w.s + CAST(ceil(w.rr) AS BIGINT)),
piv AS (SELECT event_type, max(q) FILTER (WHERE p = 0.5) AS p50, max(q) FILTER (WHERE p = 0.95) AS p95
        FROM q GROUP BY event_type),
base AS (SELECT event_type, count(*) AS n_requests,
                CASE WHEN max(ts) > min(ts) THEN CAST(count(*) AS DOUBLE) * 1000000.0
                     / CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) END AS requests_per_s
         FROM events GROUP BY event_type)
SELECT base.event_type, n_requests, requests_per_s, p50, p95 FROM base JOIN piv USING (event_type)"""

RUNNING = f"""WITH {CTE_EVENTS},
b AS (SELECT mode, "index" // 50 AS b, count(*) AS tot,
             count(*) FILTER (WHERE exact_match) AS em, count(*) FILTER (WHERE exec_match) AS ex,
             count(*) FILTER (WHERE pred_error IS NOT NULL AND db_found) AS er
      FROM ev GROUP BY mode, "index" // 50),
c AS (SELECT mode, tot, sum(tot) OVER w AS n_seen, sum(em) OVER w AS em, sum(ex) OVER w AS ex, sum(er) OVER w AS er
      FROM b WINDOW w AS (PARTITION BY mode ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT mode, n_seen, em, ex, er FROM c WHERE tot = 50
      UNION
      SELECT mode, count(*), count(*) FILTER (WHERE exact_match), count(*) FILTER (WHERE exec_match),
             count(*) FILTER (WHERE pred_error IS NOT NULL AND db_found) FROM ev WHERE "index" = 0 GROUP BY mode)
SELECT mode, CAST(n_seen AS BIGINT) AS n_seen, CAST(em AS DOUBLE) * 100.0 / n_seen AS running_em_pct,
       CAST(ex AS DOUBLE) * 100.0 / n_seen AS running_exec_pct, CAST(er AS BIGINT) AS running_errors FROM r"""

LAST_HIT = (f"CASE WHEN len(input_ids) >= {L} THEN list_max(list_filter(range(1, len(input_ids) - {L} + 2), "
            f"lambda j: input_ids[j:j + {L - 1}] = {TMPL})) END")

_LINE_REST = ("[CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), " + ", ".join(
    f"CAST(CAST({c} AS DECIMAL(18, 4)) AS VARCHAR)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ", l_linestatus, strftime(l_shipdate, '%Y-%m-%d')]")

ORACLES: dict[str, str] = {
    # sources / sinks
    "scan_catalog": f"WITH {CTE_CATALOG} SELECT db_id, pos, table_names_original, column_names_original, "
                    "column_types, primary_keys, foreign_keys FROM catalog",
    "scan_examples": f"WITH {CTE_RAW} SELECT db_id, question, query, pos FROM raw",
    "scan_catalog_array": f"""WITH {CTE_CATALOG} SELECT db_id, row_number() OVER (ORDER BY pos) - 1 AS pos, table_names_original,
        column_names_original, column_types, primary_keys, foreign_keys FROM catalog""",
    "scan_examples_array": f"WITH {CTE_RAW} SELECT db_id, question, query, row_number() OVER (ORDER BY pos) - 1 AS pos FROM raw",
    "scan_instructions": f"WITH {CTE_SPLITS} SELECT split, db_id, pos, question, output, schema, instruction FROM splits",
    "write_splits": f"WITH {CTE_SPLITS} SELECT split, db_id, pos, question, output, schema, instruction FROM splits",
    "resolve_database": f"""WITH {CTE_RAW} SELECT db_id, CAST(CASE WHEN db_id LIKE '%3' THEN 0 ELSE {len(fx.TPCH_TABLES)} END AS BIGINT) AS n_tables,
        db_id NOT LIKE '%3' AS found FROM (SELECT DISTINCT db_id FROM raw)""",
    "write_metadata": f"""WITH {CTE_SPLITS}
        SELECT 'documents' AS source, CAST({fx.VAL_RATIO} AS DOUBLE) AS val_ratio, CAST({fx.SEED} AS INTEGER) AS seed,
          count(*) FILTER (WHERE split = 'train') AS counts_train, count(*) FILTER (WHERE split = 'val') AS counts_val,
          count(*) FILTER (WHERE split = 'dev') AS counts_dev_test,
          (SELECT count(DISTINCT db_id) FROM catalog) AS num_databases_total FROM splits""",
    "write_results": f"""WITH {CTE_EVENTS}, m AS ({METRICS_SELECT.format(src="ev")}),
        p AS (SELECT mode, count(*) AS n_predictions, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), "index", db_id, question, '', '',
            CAST(exact_match AS INTEGER), CAST(exec_match AS INTEGER), CAST(db_found AS INTEGER), coalesce(pred_error, chr(30)),
            CAST(floor(generation_time_s * 1000) AS BIGINT))), 1, 12) AS BIGINT)) AS VARCHAR) AS predictions_digest FROM ev GROUP BY mode)
        SELECT m.*, CAST(CASE WHEN mode = 'few-shot' THEN {fx.FEW_SHOT_K} ELSE 0 END AS INTEGER) AS num_few_shot, CAST({fx.SEED} AS INTEGER) AS seed,
               total_examples AS config_examples, n_predictions, predictions_digest FROM m JOIN p USING (mode)""",
    # catalog
    "catalog_columns": f"""WITH {CTE_CATALOG}, {CTE_COLS}
        SELECT db_id, pos, idx AS col_idx, t AS table_idx, table_name, name AS column_name, raw_type AS column_type,
               sql_type, is_pk AS is_primary_key FROM cols""",
    "catalog_primary_keys": f"""WITH {CTE_CATALOG}, {CTE_COLS}
        SELECT db_id, pos, idx AS col_idx, table_name, name AS column_name FROM cols WHERE is_pk""",
    "catalog_foreign_keys": f"""WITH {CTE_CATALOG}, {CTE_COLS}
        SELECT db_id, pos, child_idx, child_table, child_column, parent_idx, ref_table, ref_column FROM flast""",
    "schema_ddl": f"WITH {CTE_CATALOG}, {CTE_DDL} SELECT db_id, pos, schema FROM ddl",
    "schema_lookup": f"WITH {CTE_CATALOG}, {CTE_DDL} SELECT db_id, schema FROM lookup",
    # corpus
    "convert_examples": f"WITH {CTE_EXAMPLES} SELECT instruction, schema, question, output, db_id, pos FROM examples",
    "orphan_examples": f"""WITH {CTE_EXAMPLES} SELECT db_id, count(*) AS n_skipped FROM raw
        WHERE db_id NOT IN (SELECT db_id FROM lookup) GROUP BY db_id""",
    "split_by_database": f"WITH {CTE_SPLITS} SELECT pos, db_id, split FROM splits",
    "split_order": f"""WITH {CTE_SPLITS} SELECT split, db_id, pos,
        row_number() OVER (PARTITION BY split ORDER BY db_id, pos) - 1 AS ord FROM splits""",
    "split_summary": f"""WITH {CTE_SPLITS} SELECT split, count(*) AS n_examples, count(DISTINCT db_id) AS n_databases
        FROM splits GROUP BY split""",
    # profiling
    "split_stats": f"""WITH {CTE_SPLITS} SELECT split, count(*) AS n_examples, count(DISTINCT db_id) AS n_databases,
        {_len_stats('schema', 'schema_len')}, {_len_stats('output', 'query_len')} FROM splits GROUP BY split""",
    "length_profile": f"""WITH {CTE_EXAMPLES} SELECT count(*) AS n_examples, count(DISTINCT db_id) AS n_databases,
        {_len_stats('schema', 'schema_len')}, {_len_stats('output', 'query_len')},
        min({WORDS}) AS min_question_words, max({WORDS}) AS max_question_words,
        CAST(sum({WORDS}) AS DOUBLE) / count(*) AS avg_question_words FROM examples""",
    "top_databases": f"""WITH {CTE_EXAMPLES} SELECT db_id, count(*) AS n_examples,
        CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM examples) AS pct
        FROM examples GROUP BY db_id ORDER BY n_examples DESC, min(pos) LIMIT 10""",
    "sql_feature_flags": f"WITH {CTE_EXAMPLES} SELECT pos, db_id, {_feature_flags('upper(output)')} AS features FROM examples",
    "sql_feature_distribution": _feature_distribution(),
    "token_estimate": f"""WITH {CTE_EXAMPLES},
        e AS (SELECT CAST((length(instruction) + length(schema) + length(question) + length(output)) // 4 AS BIGINT) AS est FROM examples)
        SELECT count(*) AS n_examples, min(est) AS min_tokens, max(est) AS max_tokens,
          CAST(sum(est) AS DOUBLE) / count(*) AS avg_tokens,
          count(*) FILTER (WHERE est > 512) AS n_over_512, count(*) FILTER (WHERE est > 1024) AS n_over_1024,
          CAST(count(*) FILTER (WHERE est > 512) AS DOUBLE) * 100.0 / count(*) AS pct_over_512,
          CAST(count(*) FILTER (WHERE est > 1024) AS DOUBLE) * 100.0 / count(*) AS pct_over_1024 FROM e""",
    "filter_database": f"WITH {CTE_EXAMPLES} SELECT pos, db_id, question FROM examples WHERE db_id = 'src3'",
    "available_databases": f"""WITH {CTE_EXAMPLES} SELECT db_id,
        greatest((SELECT count(DISTINCT db_id) FROM examples) - 10, 0) AS n_more
        FROM (SELECT DISTINCT db_id FROM examples) ORDER BY db_id LIMIT 10""",
    "sample_examples": f"""WITH {CTE_EXAMPLES} SELECT pos, db_id FROM examples
        ORDER BY md5('{fx.SEED}:' || CAST(pos AS VARCHAR)), pos LIMIT 20""",
    # prompts
    "prompt_zero_shot": f'WITH {CTE_SPLITS} SELECT "index", db_id, {ZERO_SHOT} AS prompt FROM test',
    "prompt_template": f'WITH {CTE_SPLITS} SELECT "index", db_id, {TEMPLATE_PROMPT} AS prompt FROM test',
    "chat_messages": f"""WITH {CTE_SPLITS}
        SELECT "index", 0 AS turn, 'system' AS role, {lit(P.SYSTEM_PROMPT)} AS content FROM test
        UNION ALL SELECT "index", 1, 'user', {ZERO_SHOT} FROM test""",
    "sft_text": f"WITH {CTE_SPLITS} SELECT pos, {TEMPLATE_PROMPT} || ' ' || output AS text FROM train",
    "select_few_shot": f'WITH {CTE_PICKS} SELECT "index", slot, pick_pos, pick_db_id FROM picks',
    "prompt_few_shot": _few_shot(P.FEW_SHOT_HEADER, FEW_SHOT_BLOCK, FEW_SHOT_TAIL),
    "prompt_few_shot_shared": _few_shot(P.SHARED_FEW_SHOT_HEADER, SHARED_BLOCK, SHARED_TAIL),
    # matching
    "extract_sql": f'WITH {CTE_EXTRACT} SELECT "index", pred_sql, strategy FROM extracted',
    "extract_strategy_counts": f"WITH {CTE_EXTRACT} SELECT strategy, count(*) AS n_responses FROM extracted GROUP BY strategy",
    "normalize_sql": f"""WITH {CTE_PAIRS}, t AS (SELECT gold_sql AS sql FROM pairs UNION SELECT pred_sql FROM pairs)
        SELECT sql, {normalize('sql')} AS normalized FROM t WHERE sql IS NOT NULL""",
    "exact_match": f"""WITH {CTE_PAIRS} SELECT pos,
        coalesce({normalize('gold_sql')} = {normalize('pred_sql')}, false) AS exact_match FROM pairs""",
    # execution
    "execute_queries": _execute_queries_sql(),
    "execution_accuracy": _execution_accuracy_sql(),
    "missing_database_verdict": f"""WITH {CTE_RAW} SELECT pos AS example_id, db_id, false AS exec_match, CAST(-1 AS BIGINT) AS gold_rows,
        CAST(-1 AS BIGINT) AS pred_rows, true AS gold_failed, true AS pred_failed, false AS db_found FROM raw WHERE db_id LIKE '%3'""",
    "prediction_records": _records_cte() + """
SELECT mode, "index", db_id, exact_match, exec_match, pred_failed, db_found, generation_time_s FROM records""",
    "error_buckets": _error_buckets_sql(),
    "compare_result_sets": f"""WITH
        li AS (SELECT l_orderkey AS id, l_linenumber, l_returnflag, CAST(l_linenumber AS VARCHAR) AS ln, {_LINE_REST} AS rest FROM lineitem),
        g AS (SELECT id, list_concat([ln], rest, [l_returnflag]) AS r, 1 AS s FROM li),
        p0 AS (SELECT id, CASE WHEN id % 13 = 0 THEN list_concat([l_returnflag, ln], rest)
                    WHEN id % 5 = 0 THEN list_concat([ln], rest, [lower(l_returnflag)])
                    ELSE list_concat([ln], rest, [l_returnflag]) END AS r, l_linenumber FROM li WHERE id % 19 <> 0),
        p AS (SELECT id, r, -1 AS s FROM p0 WHERE NOT (id % 7 = 0 AND l_linenumber = 1)
              UNION ALL SELECT id, r, -1 FROM p0 WHERE id % 11 = 0 AND l_linenumber = 1),
        d AS (SELECT id, bool_and(d = 0) AS same FROM (SELECT id, r, sum(s) AS d FROM (SELECT * FROM g UNION ALL SELECT * FROM p) GROUP BY id, r) GROUP BY id)
        SELECT o_orderkey AS example_id, (o_orderkey % 17 <> 0) AND coalesce(same, true) AS exec_match
        FROM orders LEFT JOIN d ON d.id = o_orderkey""",
    # metrics
    "eval_metrics": f"WITH {CTE_EVENTS} " + METRICS_SELECT.format(src="ev"),
    "error_rate": f"""WITH {CTE_EVENTS}, m AS ({METRICS_SELECT.format(src='ev')})
        SELECT mode, execution_error_count, total_examples, error_rate FROM m""",
    "mode_comparison": f"""WITH {CTE_EVENTS}, m AS ({METRICS_SELECT.format(src='ev')}),
        a AS (SELECT * FROM m WHERE mode = 'click'), b AS (SELECT * FROM m WHERE mode = 'view'),
        s AS (SELECT 'exact_match_accuracy' AS metric, a.exact_match_accuracy AS one, b.exact_match_accuracy AS other FROM a JOIN b ON TRUE
              UNION ALL SELECT 'execution_accuracy', a.execution_accuracy, b.execution_accuracy FROM a JOIN b ON TRUE)
        SELECT metric, one, other, other - one AS difference FROM s""",
    "model_comparison": f"""WITH {CTE_EVENTS},
        e2 AS (SELECT CASE event_id % 3 WHEN 0 THEN 'org/tuned-7b' WHEN 1 THEN 'org/base-7b' ELSE 'base' END AS model, * FROM ev)
        SELECT model, mode,
          CAST(count(*) FILTER (WHERE exact_match) AS DOUBLE) * 100.0 / count(*) AS exact_match_accuracy,
          CAST(count(*) FILTER (WHERE exec_match) AS DOUBLE) * 100.0 / count(*) AS execution_accuracy
        FROM e2 GROUP BY model, mode""",
    "limit_examples": f'WITH {CTE_EVENTS} SELECT mode, "index", event_id FROM ev WHERE "index" < 100',
    "running_metrics": RUNNING,
    "failure_sample": f"""WITH {CTE_EVENTS},
        f AS (SELECT mode, row_number() OVER (PARTITION BY mode ORDER BY "index") AS rank, "index", db_id,
                     count(*) OVER (PARTITION BY mode) AS n_failures FROM ev WHERE NOT exec_match)
        SELECT mode, rank, "index", db_id, n_failures FROM f WHERE rank <= 10""",
    "latency_summary": LATENCY,
    # batches
    "truncate_tokens": f"""WITH {CTE_TOKENS} SELECT pos, input_ids[1:{fx.MAX_SEQ}] AS input_ids,
        CAST(len(input_ids[1:{fx.MAX_SEQ}]) AS INTEGER) AS n_tokens FROM feat""",
    "default_features": f"WITH {CTE_TOKENS} SELECT pos, attention_mask, labels FROM deff",
    "pad_batch": f"WITH {CTE_TOKENS} SELECT pos, batch, input_ids, attention_mask, labels FROM padded",
    "completion_mask": f"""WITH {CTE_TOKENS}, h AS (SELECT pos, labels, {LAST_HIT} AS last FROM padded)
        SELECT pos, CASE WHEN last IS NULL THEN list_transform(labels, lambda x: -100)
                         ELSE list_transform(labels, lambda x, i: CASE WHEN i - 1 < last + {L - 1} THEN -100 ELSE x END) END AS labels
        FROM h""",
}
