"""SQL of the queries whose text is long."""

_FAR = 1000000000


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _after(state: str, cost: str, edits: str, line: str | None = None) -> str:
    """A state's cheapest way (c: cost, a: edits, r: repaired lines) with more edits behind it."""
    lines = f"{state}.r"
    if line is not None:
        lines = f"{lines} || CASE WHEN {lines} = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edits}', 'r': {lines}}}"


def _inserted() -> str:
    """The states (nothing yet, after s, after u, after a) with rows inserted at this place."""
    user, both = "'user:'", "'user:' || chr(10) || 'assistant:'"
    after_u = _best("x2", *(_after(x, "3", "I", user) for x in ("x0", "x1", "x3")))
    after_a = _best(
        "x3", _after("x2", "3", "I", "'assistant:'"), *(_after(x, "6", "II", both) for x in ("x0", "x1"))
    )
    return f"conv_id, pos, x0 AS e0, x1 AS e1, {after_u} AS e2, {after_a} AS e3"


def _stepped() -> str:
    """The states after a row: deleted, kept or given another role."""
    stays, more = "NOT gone", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    far = f"{{'c': {_FAR}, 'a': '', 'r': ''}}"

    def kept(state: str, letter: str) -> str:
        way = _after(state, more, "K", "role || ':' || text")
        return f"CASE WHEN {stays} AND initial = '{letter}' THEN {way} ELSE {far} END"

    def changed(state: str, role: str) -> str:
        way = _after(state, f"3 + {more}", "R", f"'{role}:' || text")
        return f"CASE WHEN {stays} THEN {way} ELSE {far} END"

    dropped = [_after(f"e{k}", "4", "D") for k in range(4)]
    user = [kept(f"e{k}", "u") for k in (0, 1, 3)] + [changed(f"e{k}", "user") for k in (0, 1, 3)]
    return (
        f"{dropped[0]} AS x0, {_best(dropped[1], kept('e0', 's'))} AS x1, "
        f"{_best(dropped[2], *user)} AS x2, "
        f"{_best(dropped[3], kept('e2', 'a'), changed('e2', 'assistant'))} AS x3"
    )


#: A step of CRC-32 for each bit, with a byte's value before its eight steps.
_CRC32 = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1),
    lambda i: [ord(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END
), 4294967295::BIGINT)"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), kinds AS (
  SELECT *, {_CRC32} % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos
  FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN trimmed = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), ruled AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial
                  NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal,
         count(*) AS n
  FROM ruled GROUP BY conv_id
), every AS (
  SELECT DISTINCT conv_id FROM conversations
), walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS x0,
         {{'c': {_FAR}::BIGINT, 'a': '', 'r': ''}} AS x1, {{'c': {_FAR}::BIGINT, 'a': '', 'r': ''}} AS x2,
         {{'c': {_FAR}::BIGINT, 'a': '', 'r': ''}} AS x3
  FROM every
  UNION ALL
  SELECT w.conv_id, w.pos + 1, {_stepped()}
  FROM (SELECT {_inserted()} FROM walk) w
  JOIN ruled r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1
), ended AS (
  SELECT w.conv_id, {_best("e0", "e3")} AS best
  FROM (SELECT {_inserted()} FROM walk) w
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.pos = coalesce(c.n, 0)
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(best.r) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d WHERE len(terms) > 0
), s AS (
  SELECT count(*)::BIGINT AS corpus_docs, sum(len(terms))::BIGINT AS corpus_terms FROM d WHERE len(terms) > 0
), p AS (
  SELECT row, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*)::BIGINT AS tf
  FROM t GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * corpus_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, s GROUP BY term, corpus_docs
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY item_id, term
), x AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * corpus_docs) // corpus_terms))))::BIGINT
           AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s
  GROUP BY item_id, row
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id
           ORDER BY score DESC, doc_id NULLS LAST, row)::INT AS rank, doc_id, score
  FROM x WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
