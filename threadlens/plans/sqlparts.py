"""SQL building blocks for the DuckDB oracle (the same definitions as the Spark code)."""

from __future__ import annotations

from threadlens.functions import snowball as SB
from threadlens.functions.stem import STEM_RULES
from threadlens.functions.stopwords import BLACKLIST, PUNCTUATION, STOP_WORDS
from threadlens.functions.text import entity_table
from threadlens.operators import sentences as SN
from threadlens.sources.fixtures import (ALLOWED_CATEGORIES, BLOCK, DEAD_EVENT, DELETED_BODY,
                                         DELETED_BODY_MOD, DELETED_MOD, TEXTLESS_MOD)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


DROP_WORDS = str_list(sorted(set(STOP_WORDS) | set(BLACKLIST)))
STOP_LIST = str_list(STOP_WORDS)


def items_cte(presence: bool = False, kids: bool = False, descendants: bool = False,
              name: str = "items") -> str:
    r = f"(e.event_id % {BLOCK})"
    dead = f"(e.event_type = {lit(DEAD_EVENT)} AND {r} <> 0)"
    deleted = f"(e.event_id % {DELETED_MOD} = 0 AND {r} <> 0)"
    if presence:
        dead, deleted = f"CASE WHEN {dead} THEN TRUE END", f"CASE WHEN {deleted} THEN TRUE END"
    desc_col = (f", CASE WHEN {r} = 0 THEN blk.n - 1 END AS descendants" if descendants else "")
    desc_join = (f" LEFT JOIN (SELECT event_id // {BLOCK} AS b, count(*) AS n FROM events GROUP BY 1) blk"
                 f" ON blk.b = e.event_id // {BLOCK}" if descendants else "")
    base = f"""{name}_base AS (
  SELECT e.event_id AS id,
         CASE WHEN {r} = 0 THEN 'story' ELSE 'comment' END AS type,
         b.text AS title,
         CASE WHEN e.event_id % {TEXTLESS_MOD} = 0 THEN NULL ELSE d.text END AS text,
         CASE WHEN {r} = 0 THEN NULL ELSE e.event_id - {r} + ({r} - 1) // 2 END AS parent,
         CAST(floor(epoch(e.ts)) AS BIGINT) AS time,
         CAST(e.user_id AS VARCHAR) AS "by",
         CAST(floor(e.value) AS BIGINT) AS score,
         CASE WHEN {r} = 0 THEN 'https://news.example/item/' || CAST(e.event_id AS VARCHAR) END AS url,
         {deleted} AS deleted,
         {dead} AS dead{desc_col}
  FROM events e
  LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents)
  LEFT JOIN benchmark b ON {r} = 0
       AND b.item_id = (e.event_id // {BLOCK}) % (SELECT max(item_id) + 1 FROM benchmark){desc_join}
)"""
    if kids:
        return base + f""",
{name} AS (
  SELECT i.*, k.kids FROM {name}_base i
  LEFT JOIN (SELECT parent AS pid, list(id ORDER BY id) AS kids FROM {name}_base
             WHERE parent IS NOT NULL GROUP BY parent) k ON k.pid = i.id
)"""
    return base + f""",
{name} AS (SELECT * FROM {name}_base)"""


LIVE = "NOT coalesce(deleted, FALSE) AND NOT coalesce(dead, FALSE)"


def tokens(expr: str, drop: str = DROP_WORDS) -> str:
    """Main tokenizer (F1) on a SQL expression."""
    return (f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[\\p{{L}}\\p{{N}}]+', 0), "
            f"lambda t: length(t) BETWEEN 2 AND 24 AND NOT regexp_matches(t, '[0-9]') "
            f"AND NOT list_contains({drop}, t))")


def strip_punct(expr: str) -> str:
    # DuckDB translate(): characters with no counterpart are removed.
    return f"translate({expr}, {lit(PUNCTUATION)}, '')"


def split_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[\\t\\n\\f\\r ]+'), lambda t: t <> '')"


def unescape(expr: str) -> str:
    """Named-entity decoding as one replace per entity, ``&amp;`` last."""
    table = entity_table()
    out = expr
    for name in sorted(table):
        if name == "amp":
            continue
        out = f"replace({out}, {lit('&' + name + ';')}, {lit(table[name])})"
    return f"replace({out}, '&amp;', '&')"


def tokens_freq(expr: str, legacy: bool = False) -> str:
    c = f"coalesce({expr}, '')"
    cleaned = unescape(strip_punct(f"lower({c})")) if legacy else strip_punct(f"lower({unescape(c)})")
    return f"list_filter({split_ws(cleaned)}, lambda t: NOT list_contains({STOP_LIST}, t))"


def tokens_plain(expr: str) -> str:
    return split_ws(strip_punct(f"coalesce({expr}, '')"))


def tokens_alpha(expr: str) -> str:
    cleaned = f"regexp_replace({strip_punct(f'coalesce({expr}, {lit(chr(39) * 0)})')}, '[0-9]', '', 'g')"
    return f"list_filter({split_ws(cleaned)}, lambda t: length(t) > 1 AND NOT list_contains({STOP_LIST}, t))"


def stem(expr: str) -> str:
    out = expr
    for pattern, rep in STEM_RULES:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(rep.replace('{1}', chr(92) + '1'))})"
    return out


def _case_of(expr: str, table: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def snowball_ctes(terms: str, name: str = "stems") -> str:
    """CTEs that end in ``name (term, stem)``: the Snowball English stems of the column ``term`` of the query ``terms``."""
    v, short, region = SB.VOWELS, lit(SB.SHORT), lit(SB.REGION)
    start, before = "(length(w) - length(suf))", "left(w, length(w) - length(suf))"
    special, possessive = lit(f"^({'|'.join(SB.R1_PREFIXES)})"), lit("('s'|'s|')$")
    past = "regexp_matches(" + before + f", '[{v}]')"

    def suffix(suffixes):
        return f"regexp_extract(w, {lit(SB.any_of(suffixes))}, 1)"

    def ends(pattern, word="w"):
        return f"regexp_matches({word}, {lit(pattern)})"

    steps = [
        f"SELECT term, regexp_replace(regexp_replace(regexp_replace(term, {lit(chr(94) + chr(39))}, ''), '^y', 'Y'), '([{v}])y', '\\1Y', 'g') AS w "
        f"FROM (SELECT DISTINCT term FROM ({terms}) WHERE term IS NOT NULL)",
        f"SELECT term, w, CASE WHEN regexp_matches(w, {special}) THEN length(regexp_extract(w, {special}, 1)) "
        f"WHEN regexp_matches(w, {region}) THEN length(regexp_extract(w, {region}, 0)) ELSE length(w) END AS r1 FROM {{p}}",
        f"SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), {region}) THEN r1 + length(regexp_extract(substr(w, r1 + 1), {region}, 0)) "
        f"ELSE length(w) END AS r2 FROM {{p}}",
        f"SELECT term, r1, r2, regexp_replace(w, {possessive}, '') AS w FROM {{p}}",
        f"SELECT *, {suffix(('sses', 'ied', 'ies', 'us', 'ss', 's'))} AS suf FROM {{p}}",
        f"SELECT term, r1, r2, CASE WHEN suf = 'sses' THEN left(w, length(w) - 2) WHEN suf IN ('ied', 'ies') AND {start} > 1 THEN left(w, length(w) - 2) "
        f"WHEN suf IN ('ied', 'ies') THEN left(w, length(w) - 1) WHEN suf = 's' AND {ends(f'[{v}].', before)} THEN {before} ELSE w END AS w FROM {{p}}",
        f"SELECT *, CASE WHEN list_contains({str_list(SB.AFTER_1A)}, w) THEN w END AS stays, "
        f"{suffix(('eedly', 'eed', 'ingly', 'edly', 'ing', 'ed'))} AS suf FROM {{p}}",
        f"SELECT *, suf IN ('ingly', 'edly', 'ing', 'ed') AND {past} AS less FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN suf IN ('eed', 'eedly') AND {start} >= r1 THEN {before} || 'ee' WHEN less THEN {before} ELSE w END AS w) FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN NOT less THEN w WHEN {ends('(at|bl|iz)$')} THEN w || 'e' WHEN {ends(SB.any_of(SB.DOUBLES))} "
        f"THEN left(w, length(w) - 1) WHEN r1 >= length(w) AND {ends(SB.SHORT)} THEN w || 'e' ELSE w END AS w) FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN {ends(f'.[^{v}][yY]$')} THEN left(w, length(w) - 1) || 'i' ELSE w END AS w) FROM {{p}}",
        f"SELECT * REPLACE ({suffix(SB.STEP_2)} AS suf) FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN suf <> '' AND {start} >= r1 AND (suf <> 'ogi' OR {ends('l$', before)}) "
        f"AND (suf <> 'li' OR {ends(f'[{SB.LI_ENDINGS}]$', before)}) THEN {before} || {_case_of('suf', SB.STEP_2)} ELSE w END AS w) FROM {{p}}",
        f"SELECT * REPLACE ({suffix(SB.STEP_3)} AS suf) FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN suf <> '' AND {start} >= r1 AND (suf <> 'ative' OR {start} >= r2) "
        f"THEN {before} || {_case_of('suf', SB.STEP_3)} ELSE w END AS w) FROM {{p}}",
        f"SELECT * REPLACE ({suffix(SB.STEP_4)} AS suf) FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN suf <> '' AND {start} >= r2 AND (suf <> 'ion' OR {ends('[st]$', before)}) THEN {before} ELSE w END AS w) FROM {{p}}",
        f"SELECT * REPLACE ({suffix(('e', 'l'))} AS suf) FROM {{p}}",
        f"SELECT * REPLACE (CASE WHEN suf = 'e' AND ({start} >= r2 OR ({start} >= r1 AND NOT regexp_matches({before}, {short}))) THEN {before} "
        f"WHEN suf = 'l' AND {start} >= r2 AND {ends('l$', before)} THEN {before} ELSE w END AS w) FROM {{p}}",
        f"SELECT term, CASE WHEN length(term) < 3 THEN term ELSE coalesce({_case_of('term', SB.EXCEPTIONS)}, stays, lower(w)) END AS stem FROM {{p}}",
    ]
    names = [f"{name}_{k}" for k in range(len(steps) - 1)] + [name]
    return ",\n".join(f"{n} AS ({step.replace('{p}', names[k - 1])})" for k, (n, step) in enumerate(zip(names, steps)))


def stemmed_grams_ctes(table: str, key: str, text: str, name: str = "dt") -> str:
    """CTEs that end in ``name (key, term, tf)``: counts of the 1- to 3-grams of Snowball stems in each text of a table."""
    grams = ("list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]), "
             "list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))")
    return f"""words AS (SELECT {key}, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT {key}, {tokens(text)} AS t FROM {table})),
{snowball_ctes('SELECT term FROM words')},
stemmed AS (SELECT {key}, list(stem ORDER BY pos) AS t FROM words JOIN stems USING (term) GROUP BY {key}),
{name} AS (SELECT {key}, g AS term, count(*) AS tf FROM (SELECT {key}, unnest({grams}) AS g FROM stemmed) GROUP BY {key}, g)"""


def sentence_ctes(table: str, key: str, text: str) -> str:
    """CTEs that end in ``ended (key, pos, piece, ends)`` (and ``abbr``), the sentence statistics and split over one table."""
    def bare(e):
        return f"regexp_replace(regexp_replace({e}, {lit(SN.OPENING)}, ''), {lit(SN.CLOSING)}, '')"

    def type_of(e):
        return f"lower(regexp_replace({e}, {lit(SN.TRAILING)}, ''))"

    def matches(e, pattern):
        return f"regexp_matches({e}, {lit(pattern)})"

    def certain(short):
        return f"({matches('mark', '[!?]')} OR (mark = '.' AND NOT {short} AND NOT {matches('type', SN.NUMBER)} AND length(type) > 1))"

    def term(n, p):
        return f"(CASE WHEN {n} = 0 THEN 0 ELSE {n} * ln({p}) END)"

    return f"""pieces AS (SELECT {key}, list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS p FROM {table}),
flat AS (SELECT {key}, unnest(range(len(p))) AS pos, unnest(p) AS piece, unnest(list_append(p[2:], '')) AS follower FROM pieces),
core AS (SELECT {key}, pos, piece, {bare('piece')} AS word, {bare('follower')} AS next FROM flat),
chunk AS (SELECT *, regexp_extract(word, {lit(SN.MARK)}, 1) AS mark, {type_of('word')} AS type, {type_of('next')} AS next_type FROM core),
types AS (SELECT type, count(*) FILTER (WHERE mark = '.') AS dotted, count(*) FILTER (WHERE mark <> '.') AS plain FROM chunk GROUP BY type),
share AS (SELECT sum(dotted) / sum(dotted + plain) AS p1 FROM types),
scored AS (SELECT type, dotted, plain, dotted + plain AS n, length(type) - length(replace(type, '.', '')) AS inside, p1 FROM types, share
  WHERE dotted > 0 AND regexp_matches(type, '[a-zß-öø-ÿ]')),
abbr AS (SELECT type, dotted, plain, -2 * ((dotted * ln(p1) + (n - dotted) * ln(1 - p1)) - (dotted * ln(0.99) + (n - dotted) * ln(0.01)))
  * exp(-(length(type) - inside)) * (inside + 1) / pow(CAST(length(type) - inside AS DOUBLE), plain) AS score FROM scored),
short AS (SELECT type FROM abbr WHERE score >= {SN.ABBREVIATION}),
marked AS (SELECT c.*, type IN (SELECT type FROM short) AS short FROM chunk c),
followers AS (SELECT next_type AS type, CAST(count(*) FILTER (WHERE {certain('short')}) AS DOUBLE) AS ab,
  count(*) FILTER (WHERE mark = '' AND {matches('next', SN.LETTER_FIRST_UPPER)}) AS upper_inside,
  count(*) FILTER (WHERE {matches('next', SN.LETTER_FIRST_LOWER)}) AS lower, CAST(count(*) AS DOUBLE) AS b
  FROM marked WHERE next_type <> '' GROUP BY next_type),
totals AS (SELECT sum(ab) AS a, sum(b) AS n FROM followers),
ratio AS (SELECT type, lower > 0 AND upper_inside = 0 AS common, CASE WHEN ab > 0 AND ab / a > b / n THEN -2 * (
  {term('ab', 'b / n')} + {term('(a - ab)', '1 - b / n')} + {term('(b - ab)', 'b / n')} + {term('(n - a - b + ab)', '1 - b / n')}
  - CASE WHEN a = ab THEN 0 ELSE ab * ln(ab / a) + (a - ab) * ln(1 - ab / a) END
  - CASE WHEN b = ab THEN 0 ELSE (b - ab) * ln((b - ab) / (n - a)) + (n - a - b + ab) * ln(1 - (b - ab) / (n - a)) END)
  >= {SN.STARTER} ELSE FALSE END AS starter FROM followers, totals),
joined AS (SELECT m.*, coalesce(r.starter, FALSE) OR coalesce(r.common, FALSE) AS opens FROM marked m LEFT JOIN ratio r ON r.type = m.next_type),
ended AS (SELECT {key}, pos, piece, CASE WHEN next = '' THEN TRUE WHEN mark = '' THEN FALSE WHEN {certain('short')} THEN TRUE
  WHEN mark <> '.' THEN {matches('next', SN.LETTER_FIRST_UPPER)} WHEN type = '' THEN TRUE
  WHEN {matches('type', SN.NUMBER)} AND NOT short THEN NOT {matches('next', SN.LETTER_FIRST_LOWER)}
  ELSE {matches('next', SN.LETTER_FIRST_UPPER)} AND opens END AS ends FROM joined)"""


def hash_key(id_expr: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


def hash_bucket(id_expr: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr({hash_key(id_expr, seed)}, 1, 8)) AS BIGINT) % 100)"


def tree_cte(nodes: str, roots: str, name: str = "tree") -> str:
    """Recursive thread walk: ``(root_id, id, parent, depth, path)``."""
    return f"""{name} AS (
  SELECT id AS root_id, id, parent, 0 AS depth, [id] AS path FROM {roots}
  UNION ALL
  SELECT t.root_id, n.id, n.parent, t.depth + 1, list_append(t.path, n.id)
  FROM {name} t JOIN {nodes} n ON n.parent = t.id
)"""


PATH_STR = "array_to_string(path, '/')"

ALLOWED = str_list(ALLOWED_CATEGORIES)

COMMENT_LINES = f"""comment_lines AS (
  SELECT doc_id AS id, source AS subreddit,
         CASE WHEN doc_id % {DELETED_BODY_MOD} = 0 THEN {lit(DELETED_BODY)} ELSE text END AS body
  FROM documents
)"""


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body
