"""Scalar helpers over Columns: arithmetic, comparison, text, numbers, time.

All are built-in expressions, so they stay inside code generation and push
down where Spark can.  ``strict`` behaviour (errors instead of NULL) is chosen
by the caller where it matters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: relative tolerance of numeric equality.
TOLERANCE = 1e-12


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# --- numbers -----------------------------------------------------------------


def to_number(s) -> Column:
    """Text as a number; what is no number counts as 0."""
    return F.coalesce(_col(s).try_cast("double"), F.lit(0.0))


def modulo(a, b) -> Column:
    """Remainder in [0, b) for positive b."""
    return F.pmod(_col(a), _col(b) if not isinstance(b, (int, float)) else F.lit(b))


def equal(a, b) -> Column:
    """Numeric equality with a relative tolerance."""
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * TOLERANCE


def less(a, b) -> Column:
    return (_col(a) < _col(b)) & ~equal(a, b)


def finite(c, what: str = "numeric overflow") -> Column:
    """The value, or an error if it is infinite or not a number."""
    c = _col(c)
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(what)).cast("double")).otherwise(c)


def round_half_up(c) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(_col(c) + 0.5)


def sin_degrees(c) -> Column:
    return F.sin(F.radians(_col(c)))


def cos_degrees(c) -> Column:
    return F.cos(F.radians(_col(c)))


def tan_degrees(c) -> Column:
    return F.tan(F.radians(_col(c)))


def square_root(c) -> Column:
    c = _col(c)
    return F.when(c < 0, F.raise_error(F.lit("square root of a negative number")).cast("double")).otherwise(F.sqrt(c))


def log_10(c) -> Column:
    c = _col(c)
    return F.when(c <= 0, F.raise_error(F.lit("logarithm of a number that is not positive")).cast("double")).otherwise(F.log10(c))


def power(a, b) -> Column:
    return finite(F.pow(_col(a), _col(b) if not isinstance(b, (int, float)) else F.lit(float(b))))


def random_below(n: float, seed: int) -> Column:
    return F.rand(seed) * n


def largest(*cs) -> Column:
    return F.greatest(*[_col(c) for c in cs])


def smallest(*cs) -> Column:
    return F.least(*[_col(c) for c in cs])


def total(array, *more) -> Column:
    """Sum of an array's numbers and of further columns."""
    out = F.aggregate(_col(array), F.lit(0.0), lambda a, x: a + x.cast("double"))
    for c in more:
        out = out + _col(c)
    return out


def interpolate(c, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y) points with ascending x; constant outside."""
    if len(points) < 1 or any(b[0] < a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("break points must be in ascending order")
    c = _col(c)
    out = F.when(c < points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if x1 > x0:
            out = out.when(c < x1, F.lit(float(y0)) + (c - float(x0)) * ((y1 - y0) / (x1 - x0)))
    return F.when(c.isNotNull(), out.otherwise(F.lit(float(points[-1][1]))))


def format_pattern(c, pattern: str) -> Column:
    """Decimal pattern such as ``00000`` or ``#.##``."""
    return F.call_function("format_number", _col(c), F.lit(pattern))


#: The parts of a roman numeral, digit by digit.
ROMAN = (
    ("", "M", "MM", "MMM"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
)


def roman(c) -> Column:
    """Roman numeral of a positive whole number; thousands repeat M."""
    n = F.floor(_col(c)).cast("int")
    digit = lambda k, div: F.element_at(F.array(*[F.lit(s) for s in ROMAN[k]]), ((n / div).cast("int") % 10 + 1))
    text = F.concat(F.repeat(F.lit("M"), (n / 1000).cast("int")), digit(1, 100), digit(2, 10), digit(3, 1))
    return F.when(n < 1, F.raise_error(F.lit("a roman numeral is at least 1")).cast("string")).otherwise(text)


# --- text --------------------------------------------------------------------


def number_text(c) -> Column:
    """A number as text: no trailing zeros, scientific outside 0.01 .. 1e7."""
    c = _col(c).cast("double")
    plain = F.regexp_replace(F.regexp_replace(F.format_number(c, 16), ",", ""), r"\.?0+$", "")
    plain = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(plain)
    small = (c != 0) & ((F.abs(c) < 0.01) | (F.abs(c) > 1e7))
    return F.when(small, c.cast("string")).otherwise(plain)


def join_text(*cs) -> Column:
    return F.concat(*[F.coalesce(_col(c), F.lit("")) for c in cs])


def repeat_text(s, n) -> Column:
    return F.repeat(_col(s), F.greatest(F.floor(_col(n) if not isinstance(n, (int, float)) else F.lit(n)), F.lit(0)).cast("int"))


def character(code) -> Column:
    """The UTF-16 unit with a code."""
    return F.decode(F.unhex(F.lpad(F.hex(_col(code).cast("long")), 4, "0")), "UTF-16BE")


def trim_control(s) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(_col(s), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def pad_left(s, n: int, pad: str = " ") -> Column:
    """Padded on the left; of longer text the last n characters stay."""
    s = _col(s)
    if n <= 0:
        return F.when(s.isNotNull(), F.lit(""))
    return F.when(F.length(s) > n, F.right(s, F.lit(n))).otherwise(F.lpad(s, n, pad or " "))


def pad_right(s, n: int, pad: str = " ") -> Column:
    """Padded on the right; of longer text the first n characters stay."""
    s = _col(s)
    return F.rpad(s, n, pad or " ") if n > 0 else F.when(s.isNotNull(), F.lit(""))


def substring_from(s, start, n=None) -> Column:
    """From a 1-based start (below 1: 1), n characters or the rest."""
    first = F.greatest(F.floor(start if isinstance(start, Column) else F.lit(start)), F.lit(1)).cast("int")
    size = F.length(_col(s)) if n is None else F.greatest(F.floor(n if isinstance(n, Column) else F.lit(n)), F.lit(0)).cast("int")
    return F.substring(_col(s), first, size)


def match_index(s, pattern: str) -> Column:
    """1-based place of the first match of a regular expression, 0 without."""
    return F.regexp_instr(_col(s), F.lit(pattern))


def replace_all(s, pattern: str, by: str) -> Column:
    return F.regexp_replace(_col(s), pattern, by)


def split_text(s, pattern: str = r"\s+", keep_delimiters: bool = False) -> Column:
    """Parts between matches, without empty parts at the end (and, for white
    space, at the start); optionally with the delimiters between the parts."""
    s = F.ltrim(_col(s)) if pattern == r"\s+" else _col(s)
    parts = F.split(s, pattern)
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    kept = F.slice(parts, 1, last)
    if not keep_delimiters:
        return kept
    marks = F.regexp_extract_all(s, F.lit(f"({pattern})"), 1)
    pairs = F.flatten(F.zip_with(parts, marks, lambda p, m: F.array(p, m)))
    return F.filter(pairs, lambda x: x.isNotNull() & (x != ""))


def word_wrap(s, width: int, hyphen: str | None = None, justify: bool = False, keep_newlines: bool = False) -> Column:
    """Greedy lines of at most ``width`` characters.

    A word that is wider than a line is cut with a hyphen.  With a ``hyphen``
    marker, words may also break where it stands; a hyphen shows where one
    does, and the marker never shows.  ``justify`` widens the gaps of all lines
    but the last of a paragraph, from the left.  ``keep_newlines`` makes each
    line of the text a paragraph (an empty one gives an empty line).
    """
    step = max(1, width - 1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def pieces(word: Column) -> Column:
        parts = F.filter(F.split(word, re.escape(hyphen)), lambda p: p != "") if hyphen else F.array(word)
        return F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i == 0).alias("head"), (i == F.size(parts) - 1).alias("last")))

    def place(state: Column, p: Column) -> Column:
        line, text = state["line"], p["text"]
        mark = F.when(p["last"], 0).otherwise(1)
        joined = F.concat(line, F.when(p["head"] & (line != ""), F.lit(" ")).otherwise(F.lit("")), text)
        # On a line of its own: cut while what is left, with its hyphen, is too wide.
        cuts = F.greatest(F.lit(0), F.ceil((F.length(text) + mark - width) / step)).cast("int")
        heads = F.transform(F.sequence(F.lit(1), cuts), lambda i: F.concat(F.substring(text, (i - 1) * step + 1, F.lit(step)), F.lit("-")))
        heads = F.when(cuts > 0, heads).otherwise(F.array().cast("array<string>"))
        ended = F.when(line == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(line, F.when(p["head"], F.lit("")).otherwise(F.lit("-")))))
        fits = F.length(joined) + mark <= width
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], ended, heads))
        rest = F.substring(text, cuts * step + 1, F.length(text))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(rest).alias("line"))

    def spread(line: Column) -> Column:
        words, spare = F.split(line, " "), F.greatest(F.lit(0), F.lit(width) - F.length(line))
        gaps = F.size(words) - 1
        share = lambda i: (F.floor(spare / gaps) + F.when(i < spare % gaps, 2).otherwise(1)).cast("int")
        wide = F.array_join(F.transform(words, lambda w, i: F.when(i < gaps, F.concat(w, F.repeat(F.lit(" "), share(i)))).otherwise(w)), "")
        return F.when(gaps > 0, wide).otherwise(line)

    def paragraph(text: Column) -> Column:
        words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        done = (lambda d: F.transform(d, spread)) if justify else (lambda d: d)
        last = lambda st: F.when(st["line"] == "", F.array().cast("array<string>")).otherwise(F.array(st["line"]))
        return F.aggregate(F.flatten(F.transform(words, pieces)), start, place, lambda st: F.concat(done(st["done"]), last(st)))

    if not keep_newlines:
        return paragraph(_col(s))
    lines = F.split(F.regexp_replace(_col(s), r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    empty = F.array(F.lit(""))
    return F.flatten(F.transform(lines, lambda line: F.when(F.trim(F.regexp_replace(line, r"\s", "")) == "", empty).otherwise(paragraph(line))))


# --- colours -----------------------------------------------------------------

#: The named colours of the CSS standard and their red, green, blue.
COLOURS = {
    "aliceblue": (240, 248, 255), "antiquewhite": (250, 235, 215), "aqua": (0, 255, 255), "aquamarine": (127, 255, 212),
    "azure": (240, 255, 255), "beige": (245, 245, 220), "bisque": (255, 228, 196), "black": (0, 0, 0),
    "blanchedalmond": (255, 235, 205), "blue": (0, 0, 255), "blueviolet": (138, 43, 226), "brown": (165, 42, 42),
    "burlywood": (222, 184, 135), "cadetblue": (95, 158, 160), "chartreuse": (127, 255, 0), "chocolate": (210, 105, 30),
    "coral": (255, 127, 80), "cornflowerblue": (100, 149, 237), "cornsilk": (255, 248, 220), "crimson": (220, 20, 60),
    "cyan": (0, 255, 255), "darkblue": (0, 0, 139), "darkcyan": (0, 139, 139), "darkgoldenrod": (184, 134, 11),
    "darkgray": (169, 169, 169), "darkgreen": (0, 100, 0), "darkgrey": (169, 169, 169), "darkkhaki": (189, 183, 107),
    "darkmagenta": (139, 0, 139), "darkolivegreen": (85, 107, 47), "darkorange": (255, 140, 0), "darkorchid": (153, 50, 204),
    "darkred": (139, 0, 0), "darksalmon": (233, 150, 122), "darkseagreen": (143, 188, 143), "darkslateblue": (72, 61, 139),
    "darkslategray": (47, 79, 79), "darkslategrey": (47, 79, 79), "darkturquoise": (0, 206, 209), "darkviolet": (148, 0, 211),
    "deeppink": (255, 20, 147), "deepskyblue": (0, 191, 255), "dimgray": (105, 105, 105), "dimgrey": (105, 105, 105),
    "dodgerblue": (30, 144, 255), "firebrick": (178, 34, 34), "floralwhite": (255, 250, 240), "forestgreen": (34, 139, 34),
    "fuchsia": (255, 0, 255), "gainsboro": (220, 220, 220), "ghostwhite": (248, 248, 255), "gold": (255, 215, 0),
    "goldenrod": (218, 165, 32), "gray": (128, 128, 128), "green": (0, 128, 0), "greenyellow": (173, 255, 47),
    "grey": (128, 128, 128), "honeydew": (240, 255, 240), "hotpink": (255, 105, 180), "indianred": (205, 92, 92),
    "indigo": (75, 0, 130), "ivory": (255, 255, 240), "khaki": (240, 230, 140), "lavender": (230, 230, 250),
    "lavenderblush": (255, 240, 245), "lawngreen": (124, 252, 0), "lemonchiffon": (255, 250, 205), "lightblue": (173, 216, 230),
    "lightcoral": (240, 128, 128), "lightcyan": (224, 255, 255), "lightgoldenrodyellow": (250, 250, 210), "lightgray": (211, 211, 211),
    "lightgreen": (144, 238, 144), "lightgrey": (211, 211, 211), "lightpink": (255, 182, 193), "lightsalmon": (255, 160, 122),
    "lightseagreen": (32, 178, 170), "lightskyblue": (135, 206, 250), "lightslategray": (119, 136, 153), "lightslategrey": (119, 136, 153),
    "lightsteelblue": (176, 196, 222), "lightyellow": (255, 255, 224), "lime": (0, 255, 0), "limegreen": (50, 205, 50),
    "linen": (250, 240, 230), "magenta": (255, 0, 255), "maroon": (128, 0, 0), "mediumaquamarine": (102, 205, 170),
    "mediumblue": (0, 0, 205), "mediumorchid": (186, 85, 211), "mediumpurple": (147, 112, 219), "mediumseagreen": (60, 179, 113),
    "mediumslateblue": (123, 104, 238), "mediumspringgreen": (0, 250, 154), "mediumturquoise": (72, 209, 204), "mediumvioletred": (199, 21, 133),
    "midnightblue": (25, 25, 112), "mintcream": (245, 255, 250), "mistyrose": (255, 228, 225), "moccasin": (255, 228, 181),
    "navajowhite": (255, 222, 173), "navy": (0, 0, 128), "oldlace": (253, 245, 230), "olive": (128, 128, 0),
    "olivedrab": (107, 142, 35), "orange": (255, 165, 0), "orangered": (255, 69, 0), "orchid": (218, 112, 214),
    "palegoldenrod": (238, 232, 170), "palegreen": (152, 251, 152), "paleturquoise": (175, 238, 238), "palevioletred": (219, 112, 147),
    "papayawhip": (255, 239, 213), "peachpuff": (255, 218, 185), "peru": (205, 133, 63), "pink": (255, 192, 203),
    "plum": (221, 160, 221), "powderblue": (176, 224, 230), "purple": (128, 0, 128), "rebeccapurple": (102, 51, 153),
    "red": (255, 0, 0), "rosybrown": (188, 143, 143), "royalblue": (65, 105, 225), "saddlebrown": (139, 69, 19),
    "salmon": (250, 128, 114), "sandybrown": (244, 164, 96), "seagreen": (46, 139, 87), "seashell": (255, 245, 238),
    "sienna": (160, 82, 45), "silver": (192, 192, 192), "skyblue": (135, 206, 235), "slateblue": (106, 90, 205),
    "slategray": (112, 128, 144), "slategrey": (112, 128, 144), "snow": (255, 250, 250), "springgreen": (0, 255, 127),
    "steelblue": (70, 130, 180), "tan": (210, 180, 140), "teal": (0, 128, 128), "thistle": (216, 191, 216),
    "tomato": (255, 99, 71), "turquoise": (64, 224, 208), "violet": (238, 130, 238), "wheat": (245, 222, 179),
    "white": (255, 255, 255), "whitesmoke": (245, 245, 245), "yellow": (255, 255, 0), "yellowgreen": (154, 205, 50),
}


def hsb_from_rgb(r, g, b) -> Column:
    """Hue, saturation and brightness (all 0 .. 1) of components 0 .. 1."""
    r, g, b = _col(r), _col(g), _col(b)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, F.pmod((g - b) / F.nullif(d, F.lit(0.0)), F.lit(6.0))).when(top == g, (b - r) / F.nullif(d, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(d, F.lit(0.0)) + 4) / 6
    return F.struct(hue.alias("h"), F.when(top == 0, F.lit(0.0)).otherwise(d / F.nullif(top, F.lit(0.0))).alias("s"), top.alias("b"))


def rgb_from_hsb(h, s, v) -> Column:
    h, s, v = _col(h), _col(s), _col(v)
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0)), F.lit(4.0) - F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))))
    return F.struct(part(5).alias("r"), part(3).alias("g"), part(1).alias("b"))


def adjust_hsb(r, g, b, hue: float = 1.0, saturation: float = 1.0, brightness: float = 1.0) -> Column:
    """Components after their hue, saturation and brightness are multiplied;
    saturation and brightness stay within 0 .. 1."""
    hsb = hsb_from_rgb(r, g, b)
    return rgb_from_hsb(F.pmod(hsb["h"] * hue, F.lit(1.0)), F.least(F.lit(1.0), hsb["s"] * saturation), F.least(F.lit(1.0), hsb["b"] * brightness))


def colour_name_rgb(name) -> Column:
    """Red, green, blue (0 .. 1) of a colour name in any case, with or without
    white space; null if unknown."""
    value = lambda rgb: F.struct(*[F.lit(v / 255).alias(k) for k, v in zip("rgb", rgb, strict=True)])
    known = F.create_map(*[c for n, rgb in COLOURS.items() for c in (F.lit(n), value(rgb))])
    return F.try_element_at(known, F.lower(F.regexp_replace(_col(name), r"\s", "")))


def colour_components(text: str) -> tuple[float, ...]:
    """Red, green, blue (0 .. 1) of a name, ``#rrggbb`` or ``0xrrggbb``, or the
    four components of ``cmyk(c,m,y,k)``."""
    known = re.sub(r"\s", "", text).lower()
    if found := re.fullmatch(r"(?:#|0x)([0-9a-f]{6})", known):
        return tuple(int(found[1][i : i + 2], 16) / 255 for i in (0, 2, 4))
    if found := re.fullmatch(r"cmyk\(([^,]+),([^,]+),([^,]+),([^,]+)\)", known):
        return tuple(float(v) for v in found.groups())
    if known not in COLOURS:
        raise ValueError(f"unknown colour: {text}")
    return tuple(v / 255 for v in COLOURS[known])


def _rgb(parts: tuple[float, ...]) -> tuple[float, ...]:
    """Components of a colour as red, green and blue; black is added to each ink."""
    return parts if len(parts) == 3 else tuple(1 - min(1.0, ink + parts[3]) for ink in parts[:3])


def interpolate_colour(c, points: list[tuple[float, str]]) -> Column:
    """Colour between the colours at break points.

    Below the first point and from the last one on it is the text given there.
    Between two CMYK colours it is ``cmyk(c,m,y,k)``, component by component;
    between others ``0xrrggbb``, along hue, saturation and brightness.
    """
    import colorsys

    if not points or any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("break points must be in ascending order")
    c = _col(c)
    colours = [colour_components(text) for _, text in points]
    # Room for the rounding of the way through hue, so that halves go up.
    two = lambda v: F.lpad(F.hex(round_half_up(v * 255 + 1e-11).cast("long")), 2, "0")
    out = F.when(c < float(points[0][0]), F.lit(points[0][1]))
    for (x0, _), (x1, _), low, high in zip(points, points[1:], colours, colours[1:], strict=False):
        if len(low) == len(high) == 4:
            mixed = [interpolate(c, [(x0, u), (x1, v)]).cast("float").cast("string") for u, v in zip(low, high, strict=True)]
            value = F.concat(F.lit("cmyk("), F.concat_ws(",", *mixed), F.lit(")"))
        else:
            ends = [colorsys.rgb_to_hsv(*_rgb(v)) for v in (low, high)]
            rgb = rgb_from_hsb(*[interpolate(c, [(x0, u), (x1, v)]) for u, v in zip(*ends, strict=True)])
            value = F.concat(F.lit("0x"), F.lower(F.concat(two(rgb["r"]), two(rgb["g"]), two(rgb["b"]))))
        out = out.when(c < float(x1), value)
    return F.when(c.isNotNull(), out.otherwise(F.lit(points[-1][1])))


# --- time --------------------------------------------------------------------


def time_parts(ts) -> dict[str, Column]:
    """Two-digit parts of a time; Monday is day 1 of the week."""
    ts = _col(ts)
    return {
        "year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd"),
        "hour": F.date_format(ts, "HH"), "minute": F.date_format(ts, "mm"), "second": F.date_format(ts, "ss"),
        "day_of_week": (F.weekday(ts) + 1), "week_of_year": F.weekofyear(ts), "day_of_year": F.dayofyear(ts),
    }


def timestamp_text(ts, seconds: int = 0) -> Column:
    """``Sat, Jan 3 04:05:06 UTC`` of a time some seconds later."""
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(_col(ts)) + seconds), "EEE, MMM d HH:mm:ss z")


# --- maps --------------------------------------------------------------------


def lookup(mapping, key, default: str = "") -> Column:
    """Value of a map, or the default."""
    return F.coalesce(F.try_element_at(_col(mapping), _col(key)), F.lit(default))


def ordered_keys(mapping) -> Column:
    """Keys of a map: whole numbers first in numeric order, then the others."""
    keys = F.transform(F.map_keys(_col(mapping)), lambda k: F.struct(F.coalesce(k.try_cast("long"), F.lit(2**62)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(keys), lambda s: s["k"])
