"""SQL of the character-wise operators, written as relations: a text becomes one row per character and back."""

from __future__ import annotations

import unicodedata

from onggi.functions.hangul import FINALS, INITIALS, VOWELS
from onggi.functions.text import WHITE
from onggi.operators import noise as n

M = 2147483647
_HALF = M // 2


def literal(s: str) -> str:
    plain = "".join(c for c in s if c.isprintable() and c != "'")
    return "'" + plain + "'" + "".join(f" || chr({ord(c)})" for c in s if not (c.isprintable() and c != "'"))


WHITE_SQL = "(" + literal(WHITE) + ")"
SPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')"


def lines_sql(x: str) -> str:
    t = f"replace(replace(replace(coalesce({x}, ''), chr(0), ''), chr(8203), ''), chr(65279), '')"
    return strip_sql(rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def flat_sql(x: str) -> str:
    t = f"replace(replace(replace(coalesce({x}, ''), chr(0), ''), chr(8203), ''), chr(65279), '')"
    return strip_sql(f"regexp_replace({t}, '{SPACE_CLASS}+', ' ', 'g')")


def base_sql(*parts: str) -> str:
    """Parts are SQL expressions of strings."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % {M}"


def draw_cols(name: str, stream: int, base: str = "b", pos: str = "i") -> str:
    """Lateral columns that end in the draw `name`."""
    k = stream * 362436069 % M
    return f"({base} + ({pos}::BIGINT + 1) * 1103515245 % {M} + {k}) % {M} AS {name}x, {name}x * {name}x % {M} * 69621 % {M} AS {name}"


def array(table: list[int]) -> str:
    return "[" + ", ".join(map(str, table)) + "]"


SYL = "unicode(c) BETWEEN 44032 AND 55203"
PARTS = "(unicode(c) - 44032) // 588 AS ini, (unicode(c) - 44032) % 588 // 28 AS vow, (unicode(c) - 44032) % 28 AS fin"


def stage(name: str, source: str, base: str, streams: list[int], extra: str, out: str) -> list[str]:
    """CTEs that map the characters of `source` (k, t and what `base` needs) to `name` (k, t)."""
    draws = ", ".join(draw_cols(f"d{s}", s) for s in streams)
    cols = ", ".join(x for x in (draws, extra) if x)
    return [
        f"{name}_e AS (SELECT k, {base} AS b, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) - 1 AS i FROM {source} WHERE t <> '')",
        f"{name}_n AS (SELECT k, b, c, i, coalesce(lead(c) OVER (PARTITION BY k ORDER BY i), '') AS nx FROM {name}_e)",
        f"{name}_o AS (SELECT k, i, c, nx, {PARTS}, {cols}, {out} AS o FROM {name}_n)",
        f"{name} AS (SELECT s.* EXCLUDE (t), coalesce(o.t2, s.t) AS t FROM {source} s LEFT JOIN (SELECT k, string_agg(o, '' ORDER BY i) AS t2 FROM {name}_o GROUP BY k) o USING (k))",
    ]


def below(p: float) -> int:
    return int(p * M)


def syllable_sql(ini: str, vow: str, fin: str) -> str:
    return f"chr((44032 + (({ini}) * 21 + ({vow})) * 28 + ({fin}))::INT)"


_WHITE_C = f"instr({WHITE_SQL}, c) > 0"


def spacing_stage(name: str, source: str, base: str, drop: float, insert: float) -> list[str]:
    room = f"nx <> '' AND instr({WHITE_SQL}, nx) = 0 AND instr({literal(n.NO_SPACE_BEFORE)}, nx) = 0"
    out = f"CASE WHEN {_WHITE_C} THEN CASE WHEN d0 < {below(drop)} THEN '' ELSE c END WHEN {SYL} AND d0 < {below(insert)} AND {room} THEN c || ' ' ELSE c END"
    return stage(name, source, base, [0], "", out)


def swap_stage(name: str, source: str, base: str, p: float, first: list[int], second: list[int], part: str) -> list[str]:
    a, b = array(first), array(second)
    new = f"(CASE WHEN d1 < {_HALF} THEN {a}[{part} + 1] ELSE {b}[{part} + 1] END)"
    made = syllable_sql("ini", new, "fin") if part == "vow" else syllable_sql(new, "vow", "fin")
    return stage(name, source, base, [0, 1], "", f"CASE WHEN {SYL} AND d0 < {below(p)} AND {a}[{part} + 1] >= 0 THEN {made} ELSE c END")


def vowel_stage(name: str, source: str, base: str, p: float) -> list[str]:
    return swap_stage(name, source, base, p, n._VOWEL_1, n._VOWEL_2, "vow")


def consonant_stage(name: str, source: str, base: str, p: float) -> list[str]:
    return swap_stage(name, source, base, p, n._INITIAL_1, n._INITIAL_2, "ini")


def final_stage(name: str, source: str, base: str, p: float) -> list[str]:
    half = lambda x, y: f"(CASE WHEN d2 < {_HALF} THEN {x} ELSE {y} END)"
    confused = f"CASE WHEN {array(n._FINAL_KNOWN)}[fin + 1] = 1 THEN greatest(0, {half(f'{array(n._FINAL_1)}[fin + 1]', f'{array(n._FINAL_2)}[fin + 1]')}) ELSE {half('0', 'fin')} END"
    new = (
        f"CASE WHEN fin = 0 THEN {array(n._ADDED)}[d2 * {len(n._ADDED)} // {M} + 1] WHEN d1 < {below(0.45)} THEN 0 WHEN d1 < {below(0.75)} THEN {confused} "
        f"ELSE {array(n._REPLACING)}[d2 * {len(n._REPLACING)} // {M} + 1] END"
    )
    return stage(name, source, base, [0, 1, 2], "", f"CASE WHEN {SYL} AND d0 < {below(p)} THEN {syllable_sql('ini', 'vow', new)} ELSE c END")


JAMO = f"substr('{INITIALS}', ini::INT + 1, 1) || substr('{VOWELS}', vow::INT + 1, 1) || CASE WHEN fin = 0 THEN '' ELSE substr('{''.join(FINALS)}', fin::INT, 1) END"


def jamo_stage(name: str, source: str, base: str, p: float) -> list[str]:
    return stage(name, source, base, [0], "", f"CASE WHEN {SYL} AND d0 < {below(p)} THEN {JAMO} ELSE c END")


def light_spacing_stage(name: str, source: str, base: str, p: float) -> list[str]:
    out = f"CASE WHEN {_WHITE_C} THEN CASE WHEN d0 < {below(p * 0.7)} THEN '' ELSE c END WHEN {SYL} AND nx <> '' AND unicode(nx) BETWEEN 44032 AND 55203 AND d0 < {below(p * 0.25)} THEN c || ' ' ELSE c END"
    return stage(name, source, base, [0], "", out)


def pronunciation_stage(name: str, source: str, base: str, p: float) -> list[str]:
    cte, last = [], source
    for k, (a, b) in enumerate(n.PRONUNCIATIONS):
        new = f"CASE WHEN q < {below(p)} AND instr(t, '{a}') > 0 THEN substr(t, 1, instr(t, '{a}') - 1) || '{b}' || substr(t, instr(t, '{a}') + {len(a)}) ELSE t END"
        cte.append(f"{name}_q{k} AS MATERIALIZED (SELECT *, {draw_cols('q', 3, base, str(k))} FROM {last})")
        cte.append(f"{name}_t{k} AS MATERIALIZED (SELECT * EXCLUDE (t, q, qx), {new} AS t FROM {name}_q{k})")
        last = f"{name}_t{k}"
    drop = f"CASE WHEN {SYL} AND d0 < {below(p * 0.35)} THEN {syllable_sql('ini', 'vow', '0')} ELSE c END"
    return cte + stage(name, last, base, [0], "", drop)


def pair_noise(name: str, source: str, noise: str, base, p: float = 0.12, drop: float = 0.18, insert: float = 0.015) -> list[str]:  # type: ignore[no-untyped-def]
    """CTEs of a noise type of the instruction pairs; base(stage) is the SQL of its draws' base."""
    if noise == "spacing":
        return spacing_stage(name, source, base("spacing"), drop, insert)
    if noise == "vowel":
        return vowel_stage(name, source, base("vowel"), p)
    if noise == "consonant":
        return consonant_stage(name, source, base("consonant"), p)
    if noise == "jong":
        return final_stage(name, source, base("jong"), p)
    return [
        *spacing_stage(f"{name}_1", source, base("mixed-spacing"), drop * 0.75, insert * 0.75), *vowel_stage(f"{name}_2", f"{name}_1", base("mixed-vowel"), p * 0.5),
        *consonant_stage(f"{name}_3", f"{name}_2", base("mixed-consonant"), p * 0.4), *final_stage(name, f"{name}_3", base("mixed-jong"), p * 0.5),
    ]


def bench_noise(name: str, source: str, noise: str, base, p: float = 0.12) -> list[str]:  # type: ignore[no-untyped-def]
    if noise == "jamo":
        return jamo_stage(name, source, base("jamo"), p)
    if noise == "spacing":
        return light_spacing_stage(name, source, base("spacing"), p)
    if noise == "pronunciation":
        return pronunciation_stage(name, source, base("pronunciation"), p)
    return [
        *light_spacing_stage(f"{name}_1", source, base("mixed-spacing"), p), *pronunciation_stage(f"{name}_2", f"{name}_1", base("mixed-pronunciation"), p),
        *jamo_stage(name, f"{name}_2", base("mixed-jamo"), p * 0.7),
    ]


def compose_stage(name: str, source: str) -> list[str]:
    """Joining separate jamo: a character's part follows from its neighbours."""
    has = lambda s, c: f"({c} <> '' AND instr('{s}', {c}) > 0)"
    L, V, T = INITIALS, VOWELS, "".join(FINALS)
    near = ", ".join(f"coalesce({f}(c, {d}) OVER w, '') AS {a}" for a, f, d in (("p2", "lag", 2), ("p1", "lag", 1), ("n1", "lead", 1), ("n2", "lead", 2), ("n3", "lead", 3)))
    made = f"chr((44032 + ((instr('{L}', c) - 1) * 21 + instr('{V}', n1) - 1) * 28 + CASE WHEN {has(T, 'n2')} AND NOT {has(V, 'n3')} THEN instr('{T}', n2) ELSE 0 END)::INT)"
    out = f"CASE WHEN {has(L, 'c')} AND {has(V, 'n1')} THEN {made} WHEN ({has(V, 'c')} AND {has(L, 'p1')}) OR ({has(T, 'c')} AND {has(L, 'p2')} AND {has(V, 'p1')} AND NOT {has(V, 'n1')}) THEN '' ELSE c END"
    return [
        f"{name}_e AS (SELECT k, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM {source} WHERE t <> '')",
        f"{name}_n AS (SELECT k, c, i, {near} FROM {name}_e WINDOW w AS (PARTITION BY k ORDER BY i))",
        f"{name} AS (SELECT s.* EXCLUDE (t), coalesce(o.t2, s.t) AS t FROM {source} s LEFT JOIN (SELECT k, string_agg({out}, '' ORDER BY i) AS t2 FROM {name}_n GROUP BY k) o USING (k))",
    ]


def plain_stage(name: str, source: str, out: str) -> list[str]:
    """A map of characters without draws."""
    return [
        f"{name}_e AS (SELECT k, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM {source} WHERE t <> '')",
        f"{name}_f AS (SELECT *, {PARTS} FROM {name}_e)",
        f"{name} AS (SELECT s.* EXCLUDE (t), coalesce(o.t2, s.t) AS t FROM {source} s LEFT JOIN (SELECT k, string_agg({out}, '' ORDER BY i) AS t2 FROM {name}_f GROUP BY k) o USING (k))",
    ]


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def compatibility_table() -> str:
    """A CTE of the characters that the compatibility form replaces, from the Unicode tables."""
    chars = [chr(o) for o in range(0xA0, 0x20000) if not 0xD800 <= o < 0xE000 and not 0xAC00 <= o <= 0xD7A3]
    pairs = [(c, d) for c in chars if (d := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)]
    code = lambda t: "[" + ", ".join(str(ord(c)) for c in t) + "]"
    return f"nf AS MATERIALIZED (SELECT chr(unnest({code(''.join(c for c, _ in pairs))})) AS from_c, array_to_string(list_transform(unnest([{', '.join(code(d) for _, d in pairs)}]), lambda x: chr(x)), '') AS to_c)"


def compatibility_stage(name: str, source: str) -> list[str]:
    """Compatibility forms replaced, composed, white space folded; needs compatibility_table."""
    folded = strip_sql(f"regexp_replace(nfc_normalize(coalesce(o.t2, s.t)), '{SPACE_CLASS}+', ' ', 'g')")
    return [
        f"{name}_e AS (SELECT k, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM {source} WHERE t <> '')",
        f"{name} AS (SELECT s.* EXCLUDE (t), {folded} AS t FROM {source} s LEFT JOIN (SELECT k, string_agg(coalesce(to_c, c), '' ORDER BY i) AS t2 FROM {name}_e LEFT JOIN nf ON from_c = c GROUP BY k) o USING (k))",
    ]
