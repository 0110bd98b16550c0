"""SQL text for the oracles: the same operators in plain SQL with RE2 patterns, list functions and joins."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.crypto import LETTERS, TEST_KEY, pads
from ..sources.tables import LEXICON
from ..sources.vectors import rows


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(pairs: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v) for v in row) + ")" for row in pairs)
    return f"(SELECT * FROM (VALUES {body}) v({names}))"


#: Bundled documents and the hand-made texts.
TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(rows(), 'doc_id, text')})"

_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"(length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE [0,2,4,6,8,1,3,5,7,9][substr(reverse({_DIGITS}), i, 1)::INT + 1] END)) % 10 = 0)"
_VERHOEFF = f"(length({_DIGITS}) = 12 AND list_reduce(list_transform(range(0, 12), lambda i: {R.position_table()}[(i % 8) * 10 + coalesce(try_cast(substr(reverse({_DIGITS}), i + 1, 1) AS INT), 0) + 1]), lambda c, x: {R.dihedral_table()}[c * 10 + x + 1], 0) = 0)"
_IPV4 = "(len(list_filter(string_split(value, '.'), lambda x: try_cast(x AS INT) > 255)) = 0)"
_PHONE = f"(length({_DIGITS}) BETWEEN 10 AND 15 AND len(list_distinct(string_split({_DIGITS}, ''))) > 2)"
_SSN = "(NOT regexp_matches(value, '^(000|666|9)') AND substr(value, 5, 2) <> '00' AND substr(value, 8, 4) <> '0000')"
CHECKS = {"luhn": _LUHN, "verhoeff": _VERHOEFF, "ipv4": _IPV4, "phone": _PHONE, "ssn": _SSN}


def spans(source: str, pattern: str, cols: str, where: str = "", key: str = "doc_id", text: str = "text") -> str:
    """All matches of one pattern with positions: gaps and matches summed up to each."""
    return f"""SELECT {key}, b AS start, b + length(value)::BIGINT AS "end", value, {cols} FROM (
  SELECT {key}, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS b
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, {q(pattern)}) AS m, regexp_split_to_array({text}, {q(pattern)}) AS g
    FROM {source} WHERE regexp_matches({text}, {q(pattern)})))) {where}"""


def rule_findings(source: str, which: list[int] | None = None) -> str:
    parts = []
    for i, r in enumerate(R.RULES):
        if which is None or i in which:
            parts.append(spans(source, r.re2, f"{q(r.type)} AS type, {r.priority} AS priority, {i} AS ord, 'REGEX' AS detector", f"WHERE {CHECKS[r.check]}" if r.check else ""))
    return "\nUNION ALL\n".join(parts)


NAME_RE2 = r"\b" + R.NAME_BODY + r"\b"


def name_tokens(source: str) -> str:
    listed = ", ".join(q(w) for w in LEXICON)
    return spans(source, NAME_RE2, f"value IN ({listed}) AS is_name")


def name_runs(source: str) -> str:
    """Gaps and islands over the candidate words."""
    return f"""SELECT doc_id, min(start) AS start, max("end") AS "end", substr(any_value(text), min(start)::INT + 1, (max("end") - min(start))::INT) AS value, 'NAME' AS type, {R.NAME_PRIORITY} AS priority, {R.NAME_ORD} AS ord, 'GAZETTEER' AS detector
FROM (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS island
  FROM (SELECT k.*, t.text, coalesce(is_name AND lag(is_name) OVER w AND regexp_full_match(substr(t.text, lag(k."end") OVER w::INT + 1, (k.start - lag(k."end") OVER w)::INT), '\\s+'), false) AS joins
    FROM ({name_tokens(source)}) k JOIN {source} t USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k.start)))
WHERE is_name GROUP BY doc_id, island"""


def findings(source: str = "clean") -> str:
    return rule_findings(source) + "\nUNION ALL BY NAME\n" + name_runs(source)


CLEAN = f"clean AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {q(R.PLACEHOLDER)}, {q(R.REDACTED)}, 'g') AS text FROM texts)"

RESOLVED = """lists AS (SELECT doc_id, list({'start': start, 'end': "end", 'type': type, 'value': value, 'detector': detector, 'priority': priority, 'ord': ord} ORDER BY start, priority DESC, "end" - start DESC, ord) AS l FROM found GROUP BY doc_id),
resolved AS (SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN x.start >= a.reach THEN {'reach': x."end", 'acc': list_append(a.acc, x)} ELSE a END, {'reach': -1::BIGINT, 'acc': l[1:0]}).acc, recursive := true) FROM lists)"""


def hmac(message: str, key: bytes = TEST_KEY) -> str:
    inner, outer = pads(key)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || {message})))"


def token(session: str, type_: str = "type", value: str = "value") -> str:
    message = f"encode({session}) || unhex('00') || encode({type_}) || unhex('00') || encode({value})"
    return f"('[' || {type_} || '_' || substr(translate(upper({hmac(message)}), '0123456789ABCDEF', 'ABCDEFGHIJKLMNOP'), 1, {LETTERS}) || ']')"


def rebuilt(source: str, marks: str, key: str = "doc_id") -> str:
    """(key, redacted): texts with the rows (start, end, token) of ``marks`` put in."""
    return f"""SELECT t.{key}, CASE WHEN l IS NULL THEN t.text ELSE
  list_reduce(l, lambda a, x: {{'pos': x."end", 'out': a.out || substr(t.text, a.pos::INT + 1, (x.start - a.pos)::INT) || x.token}}, {{'pos': 0::BIGINT, 'out': ''}}).out || substr(t.text, l[-1]."end"::INT + 1) END AS redacted
FROM {source} t LEFT JOIN (SELECT {key}, list({{'start': start, 'end': "end", 'token': token}} ORDER BY start) AS l FROM {marks} GROUP BY {key}) USING ({key})"""


def screening_hits(text: str = "text") -> list[tuple[str, str]]:
    out = []
    for name, p in R.SCREENING:
        if name == "OBFUSCATED_LEET_DENSITY":
            out.append((name, f"len(list_filter(regexp_extract_all(lower({text}), {q(R.LEET_WORD)}), lambda w: regexp_matches(w, {q(R.LEET_TWICE)}) AND regexp_matches(w, {q(R.LEET_FORM)}))) > 0"))
        else:
            out.append((name, f"regexp_matches({text}, {q('(?i)' + R.ascii_space(p))})"))
    return out


def first_rule(text: str = "text") -> str:
    return "CASE " + " ".join(f"WHEN {h} THEN {q(n)}" for n, h in screening_hits(text)) + " END"
