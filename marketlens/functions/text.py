"""Text normalisation: keys, tokens, similarity, tickers, titles, slugs, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Injury wording and its severity.
SEVERITIES = {
    "season-ending": 1.0,
    "60-day-il": 1.0,
    "15-day-il": 0.9,
    "10-day-il": 0.85,
    "7-day-il": 0.8,
    "injured-reserve": 1.0,
    "suspension": 1.0,
    "suspended": 1.0,
    "out for season": 1.0,
    "paternity": 1.0,
    "bereavement": 1.0,
    "personal": 0.8,
    "day-to-day": 0.3,
    "day to day": 0.3,
    "questionable": 0.5,
    "doubtful": 0.75,
    "probable": 0.25,
    "available": 0.0,
    "active": 0.0,
    "out": 1.0,
}
UNKNOWN_SEVERITY = 0.5
FUZZY_THRESHOLD = 0.7


def search_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def tokens(name: Column) -> Column:
    """Words of two characters or more, lower case, punctuation as spaces."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def words(name: Column) -> Column:
    """All alphanumeric runs, lower case."""
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")


def token_similarity(a: Column, b: Column) -> Column:
    """0.6 x Jaccard of the token sets + 0.4 when the last tokens agree."""
    union = F.size(F.array_union(a, b))
    jaccard = F.size(F.array_intersect(a, b)) / union
    last = F.when(F.element_at(a, -1) == F.element_at(b, -1), 0.4).otherwise(0.0)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.least(F.lit(1.0), jaccard * 0.6 + last)).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    return token_similarity(tokens(a), tokens(b))


def line_key(value: Column) -> Column:
    """Null-safe text of a line: 4.5 and 4.50 agree, no line is ''."""
    number = value.try_cast("double")
    whole = number == F.floor(number)
    text = F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return F.coalesce(F.when(~F.isnan(number), text), F.lit(""))


def _segments(ticker: Column) -> Column:
    return F.split(F.upper(F.trim(F.coalesce(ticker, F.lit("")))), "-")


def series_of(ticker: Column) -> Column:
    return F.element_at(_segments(ticker), 1)


def fixture_key(ticker: Column) -> Column:
    return F.coalesce(F.get(_segments(ticker), F.lit(1)), F.lit(""))


def strike_of(ticker: Column) -> Column:
    """Trailing number of the last segment; needs three segments."""
    parts = _segments(ticker)
    digits = F.regexp_extract(F.element_at(parts, -1), r"([0-9]+(?:\.[0-9]+)?)$", 1)
    return F.when((F.size(parts) >= 3) & (digits != ""), digits.try_cast("double"))


def ladder_side(ticker: Column) -> Column:
    return F.regexp_replace(F.element_at(_segments(ticker), -1), r"[0-9]+(\.[0-9]+)?$", "")


def fixture_sides(title: Column) -> Column:
    """struct<home, away> of a title such as 'A vs B winner?'; NULL when it does not name two sides."""
    text = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"\s*\?+\s*$", "")
    text = F.trim(F.regexp_replace(text, r"(?i)\s+(winner|to advance|result)$", ""))
    pattern = r"(?i)^(.+)\s+(?:vs\.?|v)\s+(.+)$"
    home = F.trim(F.regexp_extract(text, pattern, 1))
    away = F.trim(F.regexp_extract(text, pattern, 2))
    return F.when((home != "") & (away != ""), F.struct(home.alias("home"), away.alias("away")))


def outcome_side(ticker: Column, home: Column, away: Column, subtitle: Column) -> Column:
    """home, away or tie: the subtitle decides first, then the ticker suffix; NULL when unclear."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z]", "")
    h, a = letters(home), letters(away)
    raw = F.trim(F.coalesce(subtitle, F.lit("")))
    colon = F.locate(":", raw)
    named = F.when(colon > 0, F.trim(F.substr(raw, colon + 1))).otherwise(raw)
    tie = F.lower(named).isin("tie", "draw")
    cand = letters(named)
    usable = cand != ""
    home_named = usable & (F.contains(h, cand) | F.contains(cand, h))
    away_named = usable & (F.contains(a, cand) | F.contains(cand, a))
    text = F.upper(F.trim(F.coalesce(ticker, F.lit(""))))
    suffix = F.when(F.contains(text, F.lit("-")), F.element_at(F.split(text, "-"), -1)).otherwise(F.lit(""))
    known = suffix != ""
    home_match = known & F.startswith(h, suffix)
    away_match = known & F.startswith(a, suffix)
    return (
        F.when(tie, "tie")
        .when(home_named & ~away_named, "home")
        .when(away_named & ~home_named, "away")
        .when(suffix.isin("TIE", "DRAW"), "tie")
        .when(home_match & ~away_match, "home")
        .when(away_match & ~home_match, "away")
    )


def market_value(raw: Column) -> Column:
    """'€1.20bn', '450m' or '900k' to whole euros; 0 when unreadable."""
    text = F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[€,\s]", ""))
    pattern = r"^([0-9.]+)(bn|m|k)?$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.regexp_extract(text, pattern, 2)
    scale = F.when(unit == "bn", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    return F.coalesce(F.floor(number * scale + 0.5), F.lit(0)).cast("bigint")


def injury_severity(status: Column) -> Column:
    """Severity of the longest known wording found; 0.5 for other text, 0 for none."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    longest_first = sorted(SEVERITIES.items(), key=lambda kv: -len(kv[0]))
    out = F.when(text == "", 0.0)
    for token, value in longest_first:
        out = out.when(F.contains(text, F.lit(token)), value)
    return out.otherwise(UNKNOWN_SEVERITY)


def list_slug(name: Column) -> Column:
    """Lower case, punctuation dropped, spaces and dash runs as one dash."""
    kept = F.regexp_replace(F.trim(F.lower(name)), r"[^A-Za-z0-9_\s-]+", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


# Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyysz"


def club_slug(name: Column) -> Column:
    """Accents folded, anything but letters and digits as one dash; 'club' when nothing is left."""
    plain = F.translate(F.lower(name), ACCENTED, PLAIN)
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(slug == "", "club").otherwise(slug)


def feature_fingerprint(selection: Column, price: Column, prob: Column, edge: Column, books: Column, hours: Column) -> Column:
    """Hash of a candidate's rounded features, stable while nothing material changes."""
    text = F.concat_ws(
        ":",
        selection.cast("string"),
        F.format_string("%.2f", price),
        F.format_string("%.3f", prob),
        F.format_string("%.1f", edge),
        books.cast("string"),
        F.floor(hours + 0.5).cast("string"),
    )
    return F.sha2(text, 256)


def title_label(value: Column) -> Column:
    """camelCase and snake_case to Title Case; letters inside words keep their case."""
    spaced = F.regexp_replace(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " ")
    parts = F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(parts, " ")


def compact_text(value: Column, limit: int | None = None) -> Column:
    """White space made single; with ``limit`` longer texts end in an ellipsis there."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    if limit is None:
        return text
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def strip_query(path: Column) -> Column:
    return F.substring_index(F.trim(F.coalesce(path, F.lit(""))), "?", 1)


def currency_code(raw: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(code == "", "USD").otherwise(code)


def page_path(raw: Column) -> Column:
    """Path of a URL or path without query and fragment; '/' when empty."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), bare))


def browser_name(agent: Column) -> Column:
    text = F.lower(F.coalesce(agent, F.lit("")))
    out = None
    for token, name in (("edg/", "Edge"), ("firefox/", "Firefox"), ("chrome/", "Chrome"), ("safari/", "Safari")):
        hit = F.contains(text, F.lit(token))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(text != "", "Other").otherwise("Unknown")


def device_name(agent: Column) -> Column:
    text = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(text.rlike("ipad|tablet"), "Tablet")
        .when(text.rlike("mobile|android|iphone"), "Phone")
        .when(text != "", "Desktop")
        .otherwise("Unknown")
    )
