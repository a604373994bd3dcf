"""Column expressions: missing values, angles, names, guarded arithmetic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def micros(at: Column) -> Column:
    """Microseconds from 1970 to a timestamp of either kind, as its fields are written, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def millis(at: Column) -> Column:
    """As micros, in milliseconds."""
    return F.floor(micros(at) / 1000)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wrap_pi(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def fold_heading(angle: Column) -> Column:
    """The size of an angle's turn, in [0, pi]."""
    turn = F.pmod(angle, 2 * F.pi())
    return F.least(turn, 2 * F.pi() - turn)


def fold_axis(angle: Column) -> Column:
    """The angle between two undirected axes, in [0, pi / 2]."""
    turn = F.pmod(F.abs(angle), F.pi())
    return F.least(turn, F.pi() - turn)


def diagonal(width: Column, height: Column) -> Column:
    """Diagonal of a frame; sides count as 1 at least."""
    one = F.lit(1.0)
    return F.hypot(F.greatest(width.cast("double"), one), F.greatest(height.cast("double"), one))


VIDEO_NAME = r"^(\w+)_video_(.+)_(\d{8})_(\d{6})\.mp4$"


def video_camera(name: Column) -> Column:
    """Camera part of camera_video_session_date_time.mp4; null if the name has another form."""
    return F.when(name.rlike(VIDEO_NAME), F.regexp_extract(name, VIDEO_NAME, 1))


def video_session(name: Column) -> Column:
    """Session part of a video's name, `unknown` if the name has another form."""
    return F.when(name.rlike(VIDEO_NAME), F.regexp_extract(name, VIDEO_NAME, 2)).otherwise(F.lit("unknown"))


def camera_view(folder: Column) -> Column:
    """Second part of a folder's name between underscores, `unknown` if there is none."""
    return F.coalesce(F.try_element_at(F.split(folder, "_"), F.lit(2)), F.lit("unknown"))


def box_number(view: Column) -> Column:
    """Leading digit of a camera view; null if it isn't one."""
    return F.substring(view, 1, 1).try_cast("int")


def shave_key(name: Column) -> Column:
    """Pattern names that differ in case, spaces, dashes, underscores or a final `shaved` for `shave` made equal."""
    return F.regexp_replace(F.translate(F.lower(name), " -_", ""), "shaved$", "shave")


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """The value of key in a small mapping, or default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


#: Pattern names of each housing, compacted (fixed values).
ISOLATED = ("headshave", "headshaved")
GROUPED = ("noshave", "backshave", "backshaved")


def housing(name: Column) -> Column:
    """isolated or group-housed by an object's pattern name, else unknown."""
    compact = F.translate(F.lower(name), " -_", "")
    return F.when(compact.isin(*ISOLATED), "isolated").when(compact.isin(*GROUPED), "group-housed").otherwise("unknown")


def pair_kind(a: Column, b: Column) -> Column:
    """The housings of two pattern names in sorted order with a plus; single_animal without a second."""
    return F.when(b.isNull() | b.isin("", "none"), "single_animal").otherwise(F.concat_ws("+", F.array_sort(F.array(housing(a), housing(b)))))


def base_id(key: Column) -> Column:
    """An object key up to its first underscore."""
    return F.substring_index(key, "_", 1)


def safe_name(name: Column, most: int = 64) -> Column:
    """A name for a file: runs of other than letters, digits, dashes and underscores become an underscore; `unnamed` if nothing is left."""
    clean = F.trim(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}_-]+", "_"), F.lit("_"))
    return F.when(F.coalesce(clean, F.lit("")) == "", "unnamed").otherwise(F.substring(clean, 1, most))


#: Words that name a side of the cage (fixed values).
LEFT_NAMES = ("noshave", "unshaved", "unclipped")
RIGHT_NAMES = ("headshave", "backshave")
LEFT_WORDS = ("on the left", "left mouse", "left side", "left of the cage", "unshaved", "unclipped", "no shave", "noshave", "fully furred")
RIGHT_WORDS = ("on the right", "right mouse", "right side", "far right", "water bottle", "water port", "clipped patch", "head shave", "shaved")
FAR_RIGHT_WORDS = ("far right", "water bottle", "water port", "right wall", "right of the cage")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def preferred_side(text: Column, name: Column, description: Column) -> Column:
    """left or right, by an object's name first and then by the words of a request and its description; else null."""
    compact = lambda c: F.translate(F.lower(c), " -_", "")
    named = compact(F.coalesce(name, F.lit("")))
    said = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    hint = lambda words: _any_of(said, words) | _any_of(compact(said), tuple(w.replace(" ", "") for w in words))
    return F.when(_any_of(named, LEFT_NAMES), "left").when(_any_of(named, RIGHT_NAMES), "right").when(hint(LEFT_WORDS), "left").when(hint(RIGHT_WORDS), "right")


def far_right(text: Column, description: Column) -> Column:
    """Whether a request or a description names the far right of the cage."""
    return _any_of(F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(description, F.lit("")))), FAR_RIGHT_WORDS)


def stars(p: Column) -> Column:
    """Significance marks at 0.05, 0.01 and 0.001; empty for a missing p."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def p_text(p: Column) -> Column:
    """A p value as text: p=NA if it isn't finite, p<1e-4 below that, two digits below 0.001, else three decimals."""
    known = finite(p)
    return F.when(known.isNull(), "p=NA").when(known < 1e-4, "p<1e-4").when(known < 0.001, F.format_string("p=%.1e", known)).otherwise(F.format_string("p=%.3f", known))


def batch_size(value: Column, default: int = 1000) -> Column:
    """A text as a batch size: default if it is no whole number, kept in 10 to 10,000."""
    return F.greatest(F.lit(10), F.least(F.lit(10000), F.coalesce(value.try_cast("int"), F.lit(default))))


def erfc(x: Column) -> Column:
    """Complementary error function by the Chebyshev fit of Numerical Recipes (relative error below 1.2e-7)."""
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    #: Coefficients of the published fit, highest power first (fixed values).
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_p(z: Column) -> Column:
    """Two-sided p value of a standard normal deviate."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0))))
