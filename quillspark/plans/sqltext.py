"""The text functions once more as DuckDB SQL, for holding results against."""

from ..functions.text import BANGLA_DIGITS, TERMINAL, WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def joiners(x: str) -> str:
    return rf"regexp_replace({x}, '(\x{{09cd}}[\x{{200c}}\x{{200d}}])|[\x{{200c}}\x{{200d}}]', '\1', 'g')"


def nfc(x: str) -> str:
    return f"nfc_normalize({x})"


def clean_for_scoring(x: str) -> str:
    c = squeeze(rf"regexp_replace({joiners(nfc(f'coalesce({x}, {chr(39) * 2})'))}, '[\x{{200b}}\x{{feff}}]', ' ', 'g')")
    end = TERMINAL.replace("'", "''") + " \t"
    return f"translate(lower(rtrim({c}, '{end}')), '0123456789', '{BANGLA_DIGITS}')"


def clean_for_storage(x: str) -> str:
    return squeeze(nfc(joiners(rf"regexp_replace(coalesce({x}, ''), '[\x{{200b}}\x{{feff}}\x{{a0}}]', '', 'g')")))


def flat(x: str) -> str:
    return f"rtrim({strip(nfc(f'regexp_replace({x}, {chr(39)}[{WS}]+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})'))}, '।?.')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def signed(x: str, digits: int) -> str:
    return f"(CASE WHEN {x} < 0 THEN -({half_up(f'-({x})', digits)}) ELSE {half_up(x, digits)} END + 0.0)"


#: CTEs o, n, c, p and g over b (x, y, w, h, ow, oh and keys): boxes cut to the frame.
GEOMETRY = f"""o AS (SELECT *, x < 0 OR y < 0 OR x + w > 100 OR y + h > 100 AS out, greatest(0.0, -x / 100.0 * ow, -y / 100.0 * oh, (x + w - 100.0) / 100.0 * ow, (y + h - 100.0) / 100.0 * oh) AS over FROM b),
n AS (SELECT *, greatest(0.0, x) AS nx, greatest(0.0, y) AS ny, greatest(0.0, least(x + w, 100.0) - greatest(0.0, x)) AS nw, greatest(0.0, least(y + h, 100.0) - greatest(0.0, y)) AS nh FROM o),
c AS (SELECT *, CASE WHEN out THEN nx ELSE x END AS cx, CASE WHEN out THEN ny ELSE y END AS cy, CASE WHEN out THEN nw ELSE w END AS cw, CASE WHEN out THEN nh ELSE h END AS ch,
  CASE WHEN NOT out THEN 0.0 WHEN w * h > 0 THEN (1.0 - (nw * nh) / (w * h)) * 100.0 ELSE 100.0 END AS lost0 FROM n),
p AS (SELECT *, greatest(0, least(round_even(cx / 100.0 * ow, 0)::INT, ow)) AS px, greatest(0, least(round_even(cy / 100.0 * oh, 0)::INT, oh)) AS py FROM c),
g AS (SELECT *, greatest(0, least(round_even(cw / 100.0 * ow, 0)::INT, ow - px)) AS pw, greatest(0, least(round_even(ch / 100.0 * oh, 0)::INT, oh - py)) AS ph, {half_up("over", 1)} AS over_px,
  CASE WHEN lost0 < 0 THEN -({half_up("-lost0", 2)}) ELSE {half_up("lost0", 2)} END + 0.0 AS lost FROM p)"""
