"""DuckDB SQL of the detection pipeline, as a chain of common table expressions. Chains with pieces are recursive."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.labels import DEFAULT, REGIONS, SIZES
from ..functions.text import INVISIBLE_CLASS, WS
from ..operators.emissions import ATTRIBUTE_BYTES, ATTRIBUTE_OFFSETS, OUTSIDE_BIAS, PLACES, SCALE
from ..operators.segments import AUTO, BOUNDARY, LONG, SHORT, SURE, TERMINATORS
from ..operators.tokens import WINDOW, overlap, step

HEX = "('0x' || substr(md5({0}), 1, 14))::BIGINT"
SCRUBBED = f"scrubbed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{INVISIBLE_CLASS}', ' ', 'g') AS text, '' AS next FROM documents)"


def _ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+', '')"


def _rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


_B = BOUNDARY.replace("'", "''")
#: Sentences, then islands of one long sentence and the short ones behind it, then parts of each island's head, cut one by one.
SENTENCES = f"""{SCRUBBED},
stretches AS (SELECT doc_id, unnest(b) AS body, unnest(list_concat(g, [''])) AS gap, generate_subscripts(b, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '{_B}') AS b, regexp_extract_all(text, '{_B}') AS g FROM scrubbed) q),
owned AS (SELECT doc_id, i, sum(length(body) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) - length(body) - length(gap) AS pos, body || regexp_extract(gap, '^[{TERMINATORS}]') AS own FROM stretches),
sentences AS (SELECT doc_id, i, pos + length(own) - length({_ltrim("own")}) AS s, pos + length({_rtrim("own")}) AS e FROM owned WHERE {_ltrim("own")} <> '')"""
_CUT = f"""CASE WHEN e - {{a}} <= {LONG} THEN e WHEN strpos(reverse(substr(text, CAST({{a}} + {SHORT + 1} AS INT), {LONG - SHORT})), ' ') > 0
  THEN {{a}} + {LONG} - strpos(reverse(substr(text, CAST({{a}} + {SHORT + 1} AS INT), {LONG - SHORT})), ' ') ELSE {{a}} + {LONG} END"""
_REST = "substr(text, CAST(b + 1 AS INT), CAST(e - b AS INT))"
_NEXT = f"(b + length({_REST}) - length({_ltrim(_REST)}))"
PIECES = f"""{SENTENCES},
isles AS (SELECT doc_id, min(s) AS s, arg_min(e, s) AS e, max(e) AS tail FROM (SELECT *, sum(CASE WHEN e - s >= {SHORT} OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 AS first FROM sentences) q) r GROUP BY doc_id, k),
parts(doc_id, text, e, tail, a, b) AS (SELECT doc_id, text, e, tail, s, {_CUT.format(a="s")} FROM isles JOIN scrubbed USING (doc_id)
  UNION ALL SELECT doc_id, text, e, tail, {_NEXT}, {_CUT.format(a=_NEXT)} FROM parts WHERE b < e),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS piece_no, CAST(a AS BIGINT) AS start, CAST(CASE WHEN b = e THEN tail ELSE b END AS BIGINT) AS "end", text FROM parts),
cutouts AS (SELECT doc_id, piece_no, start, "end", substr(text, CAST(start + 1 AS INT), CAST("end" - start AS INT)) AS text, substr(text, CAST("end" + 1 AS INT), 1) AS next FROM pieces),
piecewise AS (SELECT doc_id || ':' || piece_no AS doc_id, text, next FROM cutouts)"""


def tokens(texts: str = "scrubbed") -> str:
    """texts: the relation (doc_id, text, next) to cut, scrubbed or piecewise."""
    return f"""{SCRUBBED if texts == "scrubbed" else PIECES},
lumps AS (SELECT doc_id, next, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT doc_id, next, regexp_extract_all(text, '[{WS}]*[^{WS}]+') AS l FROM {texts}) q),
tokens AS (SELECT doc_id, tok, "end" - length(word) AS start, "end", word, piece, after FROM (
  SELECT doc_id, tok, piece, sum(length(piece)) OVER w AS "end", {_ltrim("piece")} AS word, substr(coalesce(lead(piece) OVER w, next), 1, 1) AS after
  FROM lumps WINDOW w AS (PARTITION BY doc_id ORDER BY tok)) t)"""


TOKENS = tokens()


def windows(window: int = WINDOW, texts: str = "scrubbed") -> str:
    room, s = window - 2, step(window)
    return f"""{tokens(texts)},
ranged AS (SELECT *, greatest(0, CAST(floor((tok - {room}) / {float(s)}) AS BIGINT) + 1) AS w0,
  least(CAST(floor(tok / {float(s)}) AS BIGINT), (CASE WHEN n <= {room} THEN 1 ELSE 1 + CAST(ceil((n - {room}) / {float(s)}) AS BIGINT) END) - 1) AS w1
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens) q),
windowed AS (SELECT doc_id, tok, start, "end", word, piece, after, unnest(generate_series(w0, w1)) AS window_no FROM ranged)"""


def labelled(floor: float | None = None, window: int = WINDOW, texts: str = "scrubbed", temperatures: Mapping[str, float] | None = None) -> str:
    heads = ", ".join(f"('{h}', {i}, [{', '.join(repr(t) for t in ts)}])" for i, (h, (ts, _)) in enumerate(DEFAULT.heads.items()))
    byte = "(({d} >> {k}) & 255)::DOUBLE / CAST(" + str(SCALE) + " AS DOUBLE)"
    logits = ", ".join(f"{byte.format(d='d', k=48 - 8 * i)}{f' + CAST({OUTSIDE_BIAS} AS DOUBLE)' if i == 0 else ''} AS l{i}" for i in range(7))
    first = lambda v, a: "CASE " + " ".join(f"WHEN l{i} = {v} THEN {i}" for i in range(a, 7)) + " END"
    t = "CASE head " + " ".join(f"WHEN '{h}' THEN CAST({x or 1.0} AS DOUBLE)" for h, x in temperatures.items()) + " ELSE 1.0 END" if temperatures else "1.0"
    total = " + ".join(f"exp((l{i} - top) / temperature)" for i in range(7))
    rescued = f"(l0 = top AND 1 - exp((l0 - top) / temperature) / total >= CAST({floor} AS DOUBLE))" if floor is not None else "false"
    return f"""{windows(window, texts)},
heads(head, head_idx, tiers) AS (VALUES {heads}),
scored AS (SELECT *, {logits}, {t} AS temperature FROM (SELECT t.*, h.*, {HEX.format(f"head || ':' || word || ':' || (tok % {PLACES})")} AS d FROM ranged t CROSS JOIN heads h) q),
summed AS (SELECT *, {total} AS total FROM (SELECT *, greatest(l0, l1, l2, l3, l4, l5, l6) AS top, greatest(l1, l2, l3, l4, l5, l6) AS inner_top FROM scored) q),
decoded AS (SELECT doc_id, tok, start, "end", word, piece, after, w0, w1, head, head_idx, tiers, rescued, CASE WHEN rescued THEN {first("inner_top", 1)} ELSE {first("top", 0)} END AS label_id,
  CASE WHEN rescued THEN 1 - exp((l0 - top) / temperature) / total ELSE 1.0 / total END AS confidence FROM (SELECT *, {rescued} AS rescued FROM summed) q),
labelled AS (SELECT * EXCLUDE (tiers, w0, w1), unnest(generate_series(w0, w1)) AS window_no,
  CASE WHEN label_id = 0 THEN 'O' WHEN label_id % 2 = 1 THEN 'B' ELSE 'I' END AS prefix, CASE WHEN label_id > 0 THEN tiers[(label_id + 1) // 2] END AS tier FROM decoded)"""


def spans(floor: float | None = None, window: int = WINDOW, texts: str = "scrubbed") -> str:
    means = ", ".join(f"avg(CAST((({HEX.format(repr('attr:') + ' || word')}) >> {48 - 8 * i}) & 255 AS DOUBLE)) AS b{i}" for i in range(ATTRIBUTE_BYTES))

    def pick(name: str) -> str:
        heads, classes = DEFAULT.attributes[name]
        scores = "[" + ", ".join(f"b{(c + ATTRIBUTE_OFFSETS[name]) % ATTRIBUTE_BYTES} / 32.0 + CAST({c / 64.0} AS DOUBLE)" for c in range(len(classes))) + "]"
        names = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
        return f"CASE WHEN head IN ({', '.join(repr(h) for h in heads)}) THEN {names}[list_position({scores}, list_max({scores}))] END"

    return f"""{labelled(floor, window, texts)},
marked AS (SELECT *, prefix = 'B' OR (prefix = 'I' AND coalesce(lag(prefix) OVER w, 'O') = 'O') AS opens FROM labelled WHERE start <> "end" WINDOW w AS (PARTITION BY doc_id, window_no, head ORDER BY tok)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, window_no, head ORDER BY tok) AS span_no FROM marked),
grouped AS (SELECT doc_id, window_no, head, head_idx, span_no, min(tok) AS first_tok, max(tok) AS last_tok, arg_min(start, tok) AS start, arg_max("end", tok) AS "end",
  regexp_replace(string_agg(piece, '' ORDER BY tok), '^[{WS}]+', '') AS surface, arg_max(after, tok) AS after, first(tier ORDER BY tok) AS tier, round(avg(confidence), 6) AS confidence,
  CASE WHEN bool_or(rescued) THEN 'floor' ELSE 'argmax' END AS evidence, {means}
  FROM numbered WHERE prefix <> 'O' GROUP BY ALL),
spans AS (SELECT doc_id, window_no, head, head_idx, span_no, first_tok, last_tok, start, "end", surface, after, tier, confidence, evidence,
  {pick("origin")} AS origin, {pick("gender_expression")} AS gender, {pick("name_part")} AS name_part FROM grouped WHERE surface <> '')"""


def _greedy(source: str, to: str) -> str:
    """CTE `to`: the rows of `source` that greedy choice keeps, as a fold of each list of entities, most confident first."""
    return f"""{to}_lists AS (SELECT doc_id, head, list({{'k': -confidence, 'w': window_no, 's': start, 'e': "end", 'f': first_tok}} ORDER BY -confidence, window_no, start, "end") AS l FROM {source} GROUP BY doc_id, head),
{to}_kept AS (SELECT doc_id, head, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x[1].e AND a.e > x[1].s)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM {to}_lists),
{to} AS (SELECT s.* FROM {source} s JOIN {to}_kept k ON s.doc_id = k.doc_id AND s.head = k.head AND s.window_no = k.x.w AND s.first_tok = k.x.f AND s.start = k.x.s)"""


def suppressed(threshold: float | None = 0.7, floor: float | None = None, window: int = WINDOW) -> str:
    where = f"WHERE confidence >= CAST({threshold} AS DOUBLE)" if threshold is not None else ""
    return f"""{spans(floor, window)},
gated AS (SELECT * FROM spans {where}),
{_greedy("gated", "entities")}"""


def sentencewise(threshold: float | None, floor: float | None = None, long: bool = False) -> str:
    """CTE entities: those of the pieces, in their documents' offsets, suppressed in the piece and then in the document."""
    where = [f"confidence >= CAST({threshold} AS DOUBLE)"] * (threshold is not None) + [f"split_part(doc_id, ':', 1) IN (SELECT CAST(doc_id AS VARCHAR) FROM scrubbed WHERE length(text) > {AUTO})"] * long
    return f"""{spans(floor, texts="piecewise")},
gated AS (SELECT * FROM spans {"WHERE " + " AND ".join(where) if where else ""}),
{_greedy("gated", "inner_kept")},
lifted AS (SELECT c.doc_id, i.* EXCLUDE (doc_id, start, "end"), i.start + c.start AS start, i."end" + c.start AS "end" FROM inner_kept i JOIN cutouts c ON i.doc_id = c.doc_id || ':' || c.piece_no),
{_greedy("lifted", "entities")}"""


COLUMNS = 'doc_id, window_no, head, head_idx, first_tok, last_tok, start, "end", surface, after, tier, confidence, evidence, origin, gender, name_part'


def united(threshold: float | None = None, floor: float | None = None) -> str:
    """CTE entities: whole-text entities and the sure ones of the sentence pass of long texts that overlap nothing accepted so far."""
    where = f"WHERE confidence >= CAST({threshold} AS DOUBLE)" if threshold is not None else ""
    key = f"'s': start, 'e': \"end\", 'h': head, 'c': confidence, 'w': window_no, 'f': first_tok"
    return f"""base AS (SELECT {COLUMNS}, false AS extra FROM (WITH {suppressed(None, floor)} SELECT * FROM entities) b),
more AS (SELECT {COLUMNS}, true AS extra FROM (WITH RECURSIVE {sentencewise(SURE, floor, True)} SELECT * FROM entities) m),
either AS (SELECT * FROM base UNION ALL SELECT * FROM more),
own_lists AS (SELECT doc_id, list({{{key}, 'x': extra}}) FILTER (WHERE NOT extra) AS own, coalesce(list({{{key}, 'x': extra}} ORDER BY start, "end", head, confidence) FILTER (WHERE extra), []) AS more FROM either GROUP BY doc_id),
accepted AS (SELECT doc_id, unnest(list_reduce(list_concat([coalesce(own, [])], list_transform(more, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x[1].e AND a.e > x[1].s)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM own_lists),
entities AS (SELECT e.* FROM either e JOIN accepted a ON e.doc_id = a.doc_id AND e.extra = a.x.x AND e.start = a.x.s AND e."end" = a.x.e AND e.head = a.x.h AND e.window_no = a.x.w AND e.first_tok = a.x.f {where.replace("confidence", "e.confidence")})"""


def entities(threshold: float | None = 0.7, floor: float | None = None, segment: str = "none") -> str:
    if segment == "none":
        return suppressed(threshold, floor)
    return sentencewise(threshold, floor) if segment == "sentence" else united(threshold, floor)


def merged(**options) -> str:
    return f"""{entities(**options)},
nexts AS (SELECT *, lead(head) OVER w AS n_head, lead(start) OVER w AS n_start, lead("end") OVER w AS n_end, lead(confidence) OVER w AS n_conf, lead(evidence) OVER w AS n_ev, lead(gender) OVER w AS n_gender,
  coalesce(lead(name_part) OVER w, 'full') AS n_part, lead(surface) OVER w AS n_surface, coalesce(name_part, 'full') AS part FROM entities WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", head_idx, first_tok)),
linked AS (SELECT *, coalesce(head = 'PERSON' AND n_head = 'PERSON' AND n_start - "end" = 1 AND after = ' ' AND ((part = 'given' AND n_part = 'family') OR (part = 'family' AND n_part = 'given')), false) AS linked FROM nexts),
runs AS (SELECT *, sum(CASE WHEN was THEN 0 ELSE 1 END) OVER w AS run FROM (SELECT *, coalesce(lag(linked) OVER w, false) AS was FROM linked WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", head_idx, first_tok)) q
  WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", head_idx, first_tok)),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY start, "end", head_idx, first_tok) AS nth FROM runs),
merged AS (SELECT doc_id, head, head_idx, first_tok, start, CASE WHEN m THEN n_end ELSE "end" END AS "end", CASE WHEN m THEN surface || ' ' || n_surface ELSE surface END AS surface, tier, origin,
  CASE WHEN m THEN least(confidence, n_conf) ELSE confidence END AS confidence, CASE WHEN m AND n_ev = 'floor' THEN 'floor' ELSE evidence END AS evidence,
  CASE WHEN m THEN coalesce(CASE WHEN part = 'given' THEN gender ELSE n_gender END, gender) ELSE gender END AS gender, CASE WHEN m THEN 'full' ELSE name_part END AS name_part
  FROM (SELECT *, nth % 2 = 1 AND linked AS m FROM nth) q WHERE nth % 2 = 1)"""


def api_type(head: str = "head", part: str = "name_part") -> str:
    return "CASE " + " ".join(f"WHEN {head} = '{h}'{f" AND coalesce({part}, 'full') = '{p}'" if p else ''} THEN '{k}'" for h, p, k in DEFAULT.api) + " END"


def region(origin: str = "origin") -> str:
    return f"CASE {origin} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIONS.items()) + " ELSE 'GLOBAL' END"


def size(kind: str = "type", tier: str = "tier") -> str:
    return f"CASE WHEN {kind} = 'CITY' THEN CASE {tier} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIZES.items()) + " ELSE 'medium' END END"


def analyzed(**options) -> str:
    return f"""WITH RECURSIVE {merged(**options)},
public AS (SELECT *, {api_type()} AS type FROM merged)
SELECT doc_id, surface AS text, type, CAST(start AS BIGINT) AS start_index, CAST("end" AS BIGINT) AS end_index, tier, origin, gender, name_part, 'bert' AS source, CAST(round(CAST(confidence AS DECIMAL(18, 6)), 4) AS DOUBLE) AS confidence,
  {region()} AS region, evidence, {size()} AS size FROM public"""


OVERLAP = overlap()
