"""Scalar text and value functions (T1-T22) as Column builders.

All are built-in expressions, evaluated inside whole-stage codegen; none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters PHP's trim() strips: space, tab, newline, carriage return, NUL, vertical tab.
_PHP_WS = "[ \\t\\n\\r\\x00\\x0B]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def php_trim(x) -> Column:
    """T4: PHP ``trim``."""
    return F.regexp_replace(_c(x), f"^{_PHP_WS}+|{_PHP_WS}+$", "")


def is_falsy(x) -> Column:
    """PHP truthiness of a string: NULL, '' and '0' are empty."""
    c = _c(x)
    return c.isNull() | c.isin("", "0")


def phone_digits(x) -> Column:
    """Keep digits only."""
    return F.regexp_replace(_c(x), "\\D", "")


def phone_no_blanks(x) -> Column:
    """Remove whitespace only."""
    return F.regexp_replace(php_trim(x), "\\s+", "")


def phone_last8(x) -> Column:
    """Stored-phone key: drop blanks, dashes, then ``+856``; last 8 chars."""
    c = F.replace(F.replace(F.replace(_c(x), F.lit(" "), F.lit("")), F.lit("-"), F.lit("")),
                  F.lit("+856"), F.lit(""))
    return F.right(c, F.lit(8))


def request_phone8(x) -> Column:
    """Request-side key: digits of the trimmed input, last 8."""
    return F.right(phone_digits(php_trim(x)), F.lit(8))


def php_intval(x) -> Column:
    """T5: leading integer of a text, else 0 (``intval``). A plain integer
    text takes the cast; only other texts reach the regular expression."""
    c = _c(x)
    digits = F.regexp_extract(c, "^\\s*([+-]?\\d+)", 1)
    return F.coalesce(F.trim(c).try_cast("bigint"),
                      F.when(digits != "", digits).try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def decode_colors(x) -> Column:
    """JSON list; else a JSON object's values; else a comma list with
    blanks trimmed and empty/'0' items dropped; falsy → empty list."""
    c = _c(x)
    first = F.left(F.ltrim(c), F.lit(1))  # only what looks like JSON is parsed as such
    as_list = F.when(first == "[", F.from_json(c, "array<string>"))
    as_map = F.when(first == "{", F.map_values(F.from_json(c, "map<string,string>")))
    parts = F.filter(F.transform(F.split(c, ","), lambda s: php_trim(s)),
                     lambda s: ~s.isin("", "0"))
    return (F.when(is_falsy(c), F.array().cast("array<string>"))
            .otherwise(F.coalesce(as_list, as_map, parts)))


def decode_sizes(x) -> Column:
    """JSON list, falsy → empty list, malformed → NULL."""
    c = _c(x)
    return (F.when(is_falsy(c), F.array().cast("array<string>"))
            .otherwise(F.from_json(c, "array<string>")))


def encode_list(x) -> Column:
    """List → JSON text for storage (NULL → ``[]``)."""
    return F.to_json(F.coalesce(_c(x), F.array().cast("array<string>")))


def money_text(x) -> Column:
    """``₭`` + grouped number with up to three decimals. Rounded half-up
    first because the formatter itself rounds half-even."""
    v = F.round(F.coalesce(_c(x).cast("double"), F.lit(0.0)), 3)
    return F.concat(F.lit("₭"), F.call_function("format_number", v, F.lit("#,##0.###")))


def slug(x) -> Column:
    """Every non-alphanumeric ASCII character becomes ``-``."""
    return F.regexp_replace(_c(x), "[^a-zA-Z0-9]", "-")


def html_escape(x) -> Column:
    """Escape ``& < > "`` (ampersand first); NULL → ''."""
    c = F.coalesce(_c(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def initial(name, phone) -> Column:
    """First letter of the name upper-cased, else the phone's last two
    digits, else ``?``."""
    n = F.nullif(F.trim(_c(name)), F.lit(""))
    p = F.nullif(_c(phone), F.lit(""))
    return F.coalesce(F.upper(F.left(n, F.lit(1))), F.right(p, F.lit(2)), F.lit("?"))


def pad_code(x, width: int = 6) -> Column:
    """Left-pad a code with zeros; a longer one is never cut."""
    code = _c(x).cast("string")
    return F.lpad(code, F.greatest(F.length(code), F.lit(width)), F.lit("0"))


def order_number(created_at, order_id) -> Column:
    """O2: ``BUN-yyyyMMdd-`` and the order id in upper-case hex, at least 7
    digits, instead of a clock-based suffix; reruns give the same numbers."""
    return F.concat(F.lit("BUN-"), F.date_format(_c(created_at), "yyyyMMdd"), F.lit("-"),
                    pad_code(F.upper(F.hex(_c(order_id))), 7))


def fit_ratio(w, h, max_w: int = 1920, max_h: int = 700) -> Column:
    """Scale that fits ``w × h`` into the banner box, never enlarging."""
    return F.least(F.lit(1.0), F.lit(float(max_w)) / _c(w), F.lit(float(max_h)) / _c(h))


def js_round(x) -> Column:
    """``Math.round``: half up."""
    return F.floor(_c(x) + F.lit(0.5)).cast("bigint")


def display_date(x, pattern: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Formatted timestamp, ``—`` when missing."""
    return F.coalesce(F.date_format(_c(x), pattern), F.lit("—"))


def first_truthy(*cols) -> Column:
    """PHP ``a ?: b`` chain (falsy → next)."""
    out = None
    for c in reversed(cols):
        c = _c(c)
        out = c if out is None else F.when(is_falsy(c), out).otherwise(c)
    return out


def js_or(*cols) -> Column:
    """JS ``a || b`` for strings: NULL and '' fall through."""
    out = None
    for c in reversed(cols):
        c = _c(c)
        out = c if out is None else F.when(c.isNull() | (c == ""), out).otherwise(c)
    return out


# Colour name → swatch hex used by the shop front.
COLOR_HEX = {
    "ແດງ": "#e74c3c", "ຟ້າ": "#3498db", "ຂຽວ": "#27ae60", "ເຫລືອງ": "#f1c40f",
    "ດຳ": "#1a1a1a", "ຂາວ": "#f0f0f0", "ບົວ": "#ff69b4", "ສົ້ມ": "#e67e22",
    "ມ່ວງ": "#9b59b6", "ນ້ຳຕານ": "#8B4513", "ຊາ": "#c9a96e", "ເທົາ": "#95a5a6",
}
NO_COLOR = "#ccc"

# Order status labels of the admin pages.
ADMIN_STATUS_LABELS = {
    "pending": "ລໍຖ້າ", "confirmed": "ຢືນຢັນ", "shipped": "ຈັດສົ່ງ",
    "completed": "ສຳເລັດ", "cancelled": "ຍົກເລີກ",
}
# Order status labels of the customer profile page.
CUSTOMER_STATUS_LABELS = {
    "pending": "ລໍຖ້າ", "confirmed": "ຢືນຢັນ", "shipped": "ກຳລັງສົ່ງ",
    "delivered": "ສົ່ງແລ້ວ", "cancelled": "ຍົກເລີກ",
}


def literal_map(d: dict) -> Column:
    """A constant map expression: a lookup with no join and no broadcast."""
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def color_hex(x) -> Column:
    """Known colour → hex; falsy → ``#ccc``; unknown → itself."""
    c = _c(x)
    return js_or(F.try_element_at(literal_map(COLOR_HEX), c), c, F.lit(NO_COLOR))


def status_label(x, labels: dict = ADMIN_STATUS_LABELS) -> Column:
    """Label of a status, falling back to the raw status."""
    c = _c(x)
    return js_or(F.try_element_at(literal_map(labels), c), c)
