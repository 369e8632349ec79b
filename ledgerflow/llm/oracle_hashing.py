"""DuckDB SQL of the queries whose rows rest on XXH64 and CRC-32, which DuckDB lacks.

XXH64 is spelled out on UHUGEINT modulo 2^64. Values used twice are bound to
a name by a lambda over a one-element list. Constants are those of the hash.
"""

from __future__ import annotations

from ledgerflow.llm import imatch, resampling, simhash_dedup

_WRAP = 1 << 64
_P1, _P2, _P3, _P4, _P5 = (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)
SEED = 42


def _big(value: int) -> str:
    return f"{value % _WRAP}::UHUGEINT" if value != _WRAP else f"{value}::UHUGEINT"


def _wrapped(expression: str) -> str:
    return f"(({expression}) % {_big(_WRAP)})"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _rotated(name: str, bits: int) -> str:
    return f"({_wrapped(f'{name} * {_big(1 << bits)}')} + {name} // {_big(1 << (64 - bits))})"


def _round(accumulator: str, lane: str) -> str:
    return _let(_wrapped(f"{accumulator} + {lane} * {_big(_P2)} % {_big(_WRAP)}"), "t", _wrapped(f"{_rotated('t', 31)} * {_big(_P1)}"))


def _lane(start: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from byte ``start`` of the hexadecimal column x."""
    pairs = " || ".join(f"substr(x, 2 * ({start}) + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"CAST('0x' || {pairs} AS UBIGINT)::UHUGEINT"


def _mixed(value: str, bits: int, factor: int, offset: int = 0) -> str:
    return _let(value, "u", _wrapped(f"{_rotated('u', bits)} * {_big(factor)} + {_big(offset)}"))


def _avalanche(h: str) -> str:
    for shift, factor in ((33, _P2), (29, _P3)):
        h = _let(h, "u", _wrapped(f"xor(u, u // {_big(1 << shift)}) * {_big(factor)}"))
    return _let(h, "u", f"xor(u, u // {_big(1 << 32)})")


def hashed_strings(strings: str, name: str) -> str:
    """CTEs that end in ``name`` (s, h UBIGINT): the XXH64 of every s of the CTE ``strings``."""
    first = ", ".join(_big(SEED + d) for d in (_P1 + _P2, _P2, 0, -_P1))
    lanes = ", ".join(_lane(f"32 * i + {8 * k}", 8) for k in range(4))
    rounds = ", ".join(_round(f"v[{k}]", f"w[{k}]") for k in (1, 2, 3, 4))
    merged = _wrapped(" + ".join(_rotated(f"v[{k}]", r) for k, r in ((1, 1), (2, 7), (3, 12), (4, 18))))
    for k in (1, 2, 3, 4):
        merged = _let(merged, "a", _wrapped(f"xor(a, {_round(_big(0), f'v[{k}]')}) * {_big(_P1)} + {_big(_P4)}"))
    stripes = f"list_reduce(list_prepend([{first}], list_transform(range(n // 32), lambda i: [{lanes}])), lambda v, w: [{rounds}])"
    start = f"CASE WHEN n >= 32 THEN {_let(stripes, 'v', merged)} ELSE {_big(SEED + _P5)} END + n::UHUGEINT"
    eight = _mixed(f"xor(a, {_round(_big(0), 'k')})", 27, _P1, _P4)
    four = _mixed(f"xor(h, {_wrapped(f'{_lane("n // 8 * 8", 4)} * {_big(_P1)}')})", 23, _P2, _P3)
    one = _mixed(f"xor(a, {_wrapped(f'k * {_big(_P5)}')})", 11, _P1)
    return f"""
        {name}_1 AS (SELECT s, hex(s) AS x, strlen(s) AS n FROM {strings}),
        {name}_2 AS (SELECT *, {_wrapped(start)} AS h FROM {name}_1),
        {name}_3 AS (SELECT * REPLACE (list_reduce(list_prepend(h, list_transform(range(n % 32 // 8),
            lambda i: {_lane("n // 32 * 32 + 8 * i", 8)})), lambda a, k: {eight}) AS h) FROM {name}_2),
        {name}_4 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h) FROM {name}_3),
        {name}_5 AS (SELECT * REPLACE (list_reduce(list_prepend(h, list_transform(range(n % 4),
            lambda i: {_lane("n // 4 * 4 + i", 1)})), lambda a, k: {one}) AS h) FROM {name}_4),
        {name} AS MATERIALIZED (SELECT s, {_avalanche("h")}::UBIGINT AS h FROM {name}_5)"""


def _hashed_longs(longs: str) -> str:
    """The hash of a list of numbers, each hashed with the hash before it as its seed."""
    step = _avalanche(_mixed(f"xor({_wrapped(f'a + {_big(_P5 + 8)}')}, {_round(_big(0), 'k')})", 27, _P1, _P4))
    return f"list_reduce(list_prepend({_big(SEED)}, {longs}), lambda a, k: {step})"


def simhash_sql() -> str:
    """``op10_simhash``: fingerprints, all pairs of them within the distance, and what each reaches."""
    width, most = simhash_dedup.SHINGLE, simhash_dedup.MAX_BITS
    counts = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
    code = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0 END" for b in range(64))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, row_number() OVER () AS place,
                   regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), shingles AS (
            SELECT place, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
                   ELSE list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i:i + {width - 1}], ' ')) END) AS s
            FROM texts
        ), strings AS (SELECT DISTINCT s FROM shingles), {hashed_strings("strings", "hashed")},
        counted AS (SELECT place, count(*) AS n, {counts} FROM shingles JOIN hashed USING (s) GROUP BY place),
        codes AS MATERIALIZED (
            SELECT doc_id, coalesce(code, 0) AS code FROM texts LEFT JOIN (SELECT place, {code} AS code FROM counted) USING (place)
        ), nodes AS MATERIALIZED (SELECT code, min(doc_id) AS first_id FROM codes GROUP BY code),
        links AS MATERIALIZED (
            SELECT a.code AS one, b.code AS other FROM nodes a JOIN nodes b
            ON a.code <> b.code AND bit_count(xor(a.code, b.code)::HUGEINT) <= {most}
        ), reached AS (
            SELECT code, code AS other FROM nodes
            UNION SELECT reached.code, links.other FROM reached JOIN links ON reached.other = links.one
        ), components AS (
            SELECT reached.code, min(first_id) AS component_id FROM reached JOIN nodes ON reached.other = nodes.code GROUP BY reached.code
        )
        SELECT doc_id, lpad(lower(to_hex(code)), 16, '0') AS fingerprint, component_id FROM codes JOIN components USING (code)
    """


def imatch_sql() -> str:
    """``op9_imatch`` for tables without repeated ids."""
    classes, subset_bits, subsets = 1 << imatch.CLASS_BITS, imatch.SUBSET_BITS, imatch.SUBSETS
    share = "CASE WHEN len(list_filter(z, lambda p: p.x <> '' OR p.y <> '')) = 0 THEN 1.0 ELSE " \
        "len(list_filter(z, lambda p: p.x <> '' AND p.x = p.y)) / len(list_filter(z, lambda p: p.x <> '' OR p.y <> '')) END"

    def likeness(a: str, b: str) -> str:
        def shared(x: str, y: str) -> str:
            zipped = f"list_transform(range(1, {subsets + 1}), lambda i: {{'x': {a}_{x}[i], 'y': {b}_{y}[i]}})"
            return _let(zipped, "z", share)

        return f"CASE {b}_level - {a}_level WHEN 0 THEN {shared('here', 'here')} WHEN 1 THEN {shared('above', 'here')} " \
            f"WHEN -1 THEN {shared('here', 'above')} ELSE 0.0 END"

    def spelled(a: str) -> str:
        return f"{a}_level || ':' || array_to_string({a}_here, ',') || '/' || array_to_string({a}_above, ',')"

    def columns(a: str) -> str:
        return f"{a}.level AS {a}_level, {a}.here AS {a}_here, {a}.above AS {a}_above"

    return rf"""
        WITH ordered AS MATERIALIZED (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER by_id AS place,
                   coalesce(lead(coalesce(text, '')) OVER by_id, first_value(coalesce(text, '')) OVER by_id) AS following
            FROM documents WINDOW by_id AS (ORDER BY doc_id NULLS LAST)
        ), edited AS MATERIALIZED (
            SELECT *, length(text) AS n_chars,
                   substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4) AS edited
            FROM ordered
        ), texts AS (SELECT place, false AS changed, text FROM edited UNION ALL SELECT place, true, edited FROM edited),
        terms AS MATERIALIZED (
            SELECT place, changed, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS s FROM texts
        ), strings AS (SELECT DISTINCT s FROM terms), {hashed_strings("strings", "hashed")},
        found AS MATERIALIZED (
            SELECT place, changed, h, CASE WHEN h >= {1 << 63} THEN (h::HUGEINT - {_WRAP})::BIGINT ELSE h::BIGINT END AS signed,
                   h AS term
            FROM terms JOIN hashed USING (s)
        ), lexicon AS (
            SELECT term FROM found WHERE NOT changed GROUP BY term
            HAVING count(DISTINCT place) >= {imatch.LOW_DOCS}
               AND count(DISTINCT place) <= {imatch.HIGH_SHARE!r}::DOUBLE * (SELECT count(*) FROM ordered)
        ), banded AS (
            SELECT found.*, lexicon.term IS NOT NULL AS inside,
                   count(lexicon.term) OVER (PARTITION BY place, changed) AS n_inside, count(*) OVER (PARTITION BY place, changed) AS n_all
            FROM found LEFT JOIN lexicon USING (term)
        ), kept AS (SELECT * FROM banded WHERE inside OR n_inside < {imatch.FEW_TERMS}),
        levels AS (
            SELECT place, changed, count(h) AS n,
                   greatest(0, ceil(log2(greatest(count(h), 1) / {subsets}.0)))::INTEGER AS level
            FROM texts LEFT JOIN kept USING (place, changed) GROUP BY place, changed
        ), hashes AS (
            SELECT place, changed, step, (h // {classes}) % {subsets} AS subset, list(h::UHUGEINT ORDER BY signed) AS own
            FROM kept JOIN levels USING (place, changed), range(2) r(step)
            WHERE (h // {classes << subset_bits}) % (1::UBIGINT << (level + step)) = 0
            GROUP BY place, changed, step, subset
        ), marks AS (
            SELECT place, changed, level, step, subset,
                   CASE WHEN own IS NULL THEN ''
                        ELSE lpad(lower(to_hex(({_hashed_longs("own")} % 65536::UHUGEINT)::UBIGINT)), 4, '0') END AS mark
            FROM levels CROSS JOIN range(2) r(step) CROSS JOIN range({subsets}) q(subset) LEFT JOIN hashes USING (place, changed, step, subset)
        ), prints AS MATERIALIZED (
            SELECT place, changed, any_value(level) AS level, list(mark ORDER BY subset) FILTER (WHERE step = 0) AS here,
                   list(mark ORDER BY subset) FILTER (WHERE step = 1) AS above
            FROM marks GROUP BY place, changed
        ), joined AS (
            SELECT doc_id, n_chars, edited, {columns("a")}, {columns("b")}, {columns("c")}
            FROM edited JOIN prints a ON a.place = edited.place AND NOT a.changed
            JOIN prints b ON b.place = edited.place AND b.changed
            JOIN prints c ON c.place = edited.place % (SELECT count(*) FROM ordered) + 1 AND NOT c.changed
        )
        SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {spelled("a")} AS fingerprint, {spelled("b")} AS edited_fingerprint,
               CAST({likeness("a", "b")} AS DOUBLE) AS near_edited, CAST({likeness("a", "c")} AS DOUBLE) AS near_next
        FROM joined
    """


CRC_TABLE = """crc_table AS MATERIALIZED (
            SELECT list(list_reduce(list_prepend(n, range(8)),
                        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
            FROM range(256) r(n)
        )"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8, beside ``crc_table`` in the same FROM."""
    numbers = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _signed(h: str) -> str:
    return f"(CASE WHEN {h} >= {1 << 63} THEN {h}::HUGEINT - {_WRAP} ELSE {h}::HUGEINT END)"


def resampling_sql() -> str:
    """``op4_resampling``: both models, the cut between good and bad rows, and the k largest perturbed weights."""
    r = resampling
    bucket = lambda h: f"(({_signed(h)} % {r.BUCKETS} + {r.BUCKETS}) % {r.BUCKETS})::INTEGER"
    paired = f"xor({_wrapped('h::UHUGEINT * 2')}::UBIGINT, following)"
    return rf"""
        WITH {CRC_TABLE}, rows AS MATERIALIZED (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS place FROM documents
        ), tokens AS MATERIALIZED (
            SELECT place, unnest(words) AS s, unnest(range(len(words))) AS i
            FROM (SELECT place, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\s\p{{L}}\p{{M}}\p{{N}}_]+') AS words FROM rows)
        ), known AS (
            SELECT doc_id AS label_id, min(quality) AS label FROM labels, crc_table
            WHERE doc_id IS NOT NULL AND quality IN (0, 1) AND {crc32("CAST(doc_id AS VARCHAR)")} % {r.HELD_OUT} <> 0 GROUP BY doc_id
        ), strings AS (
            SELECT s FROM tokens UNION SELECT text FROM rows UNION SELECT CAST(label_id AS VARCHAR) FROM known
        ), {hashed_strings("strings", "hashed")},
        used AS MATERIALIZED (
            SELECT label_id, CASE WHEN label = 0 THEN {r.BAD} WHEN {_hashed_longs("[h::UHUGEINT]")} % 2::UHUGEINT = 0 THEN {r.COUNTED} ELSE {r.GOOD} END AS role
            FROM known JOIN hashed ON s = CAST(label_id AS VARCHAR)
            QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_signed("h")}, label_id) <= {r.LABELLED_ROWS}
        ), noisy AS (
            SELECT place, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || lower(to_hex(h)) || '#{r.SEED}' AS s
            FROM rows JOIN hashed ON s = text
        ), noise_strings AS (SELECT DISTINCT s FROM noisy), {hashed_strings("noise_strings", "noise_hashed")},
        noises AS (
            SELECT place, -ln(-ln(((h >> 12)::DOUBLE + 0.5) * pow(2, -52))) AS noise FROM noisy JOIN noise_hashed USING (s)
        ), neighbours AS (
            SELECT place, h, lead(h) OVER (PARTITION BY place ORDER BY i) AS following FROM tokens JOIN hashed USING (s)
        ), features AS MATERIALIZED (
            SELECT place, {bucket("h")} AS bucket FROM neighbours
            UNION ALL SELECT place, CASE WHEN h = following THEN 0 ELSE {bucket(paired)} END FROM neighbours WHERE following IS NOT NULL
        ), roles AS (SELECT place, role FROM rows LEFT JOIN used ON doc_id = label_id),
        counts AS (
            SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE role = {r.COUNTED}) AS good FROM features JOIN roles USING (place) GROUP BY bucket
        ), ratios AS (
            SELECT bucket, CAST(round(ln((good + {r.SMOOTHING}::DOUBLE)
                   / (raw * (SELECT sum(good)::DOUBLE / sum(raw)::DOUBLE FROM counts) + {r.SMOOTHING}::DOUBLE)) * {r.UNITS}) AS BIGINT) AS ratio
            FROM counts
        ), totals AS (SELECT place, sum(ratio) AS units FROM features JOIN ratios USING (bucket) GROUP BY place),
        weights AS MATERIALIZED (
            SELECT place, doc_id, role, coalesce(units, 0)::BIGINT / {float(r.UNITS)!r}::DOUBLE AS weight, noise
            FROM rows JOIN roles USING (place) JOIN noises USING (place) LEFT JOIN totals USING (place)
        ), marked AS (
            SELECT weight, lag(weight) OVER by_weight AS under,
                   count(*) FILTER (WHERE role = {r.BAD}) OVER from_here + count(*) FILTER (WHERE role = {r.GOOD}) OVER before AS wrong
            FROM weights WHERE role IN ({r.GOOD}, {r.BAD})
            WINDOW by_weight AS (ORDER BY weight), from_here AS (ORDER BY weight RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                   before AS (ORDER BY weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)
        ), cut AS (
            SELECT coalesce((weight + under) / 2, weight) AS cut FROM marked
            WHERE under IS NULL OR under < weight ORDER BY wrong, weight LIMIT 1
        ), stepped AS (
            SELECT *, floor((weight + noise) * {r.STEPS})::BIGINT AS step, weight >= (SELECT cut FROM cut) AS passes FROM weights
        ), least AS (
            SELECT step FROM (SELECT step, row_number() OVER (ORDER BY step DESC) AS n FROM stepped)
            WHERE n = (SELECT count(*) FILTER (WHERE passes) FROM stepped)
        )
        SELECT doc_id, weight AS log_weight, round(1.0 / (1.0 + exp(-weight)), 6) AS score, step / {float(r.STEPS)!r}::DOUBLE AS perturbed,
               step >= (SELECT step FROM least) AS kept,
               doc_id IS NOT NULL AND {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % {r.HELD_OUT} = 0 AS held_out
        FROM stepped, crc_table
    """
