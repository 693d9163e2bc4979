"""Name and text expressions of the line model; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and patterns that results must equal.
KIND_PATTERNS = [
    ("특급", "特急|Limited Express"),
    ("통근쾌속", "通勤快速|通勤特快|通勤急行|通勤準急|区間急行|区間快速"),
    ("쾌속", "新快速|快速|マリンライナー"),
    ("급행", "急行(?!電鉄|鉄道|線)"),
    ("준급", "準急"),
    ("각역정차", "各駅停車|各停|普通|Local"),
]
PLATFORM_TAIL = r"(?:\s*\d+\s*番(?:のりば|線)|\s*のりば|\s*ホーム)$"
NUMBER_TAIL = r"[\s._-]*\d+(?:[.\-_]\d+)*$"
DIRECTION_SIGN = "^(.+?)駅.+方面$"
STATION_TAIL = r"駅[\d０-９\s･・.\-_]+$"
KOREAN_TAIL = r"(?<=[가-힣])\s*역$|(?<=[가-힣])\s+시$"
BRACKETS = "[(（].*$"
COLOUR_FIELD = r"(?:路線色|ラインカラー|ラインの色)\s*=\s*([^\n|}]+)"
KIND_WORDS = ["各駅停車", "各停", "普通", "新快速", "区間快速", "区間急行", "通勤快速", "通勤急行", "通勤準急", "快速急行", "快速", "準急", "急行", "特急", "直通線?", "直通運転"]
#: Lowest and highest channel of a colour of lightness 0.42 and saturation 0.62.
TONE_HIGH = 0.42 * 1.62
TONE_LOW = 2 * 0.42 - TONE_HIGH


def kind_of(name: Column, companies: list[str] | None = None) -> Column:
    """The first kind whose pattern is found in the name once company names are taken out; null without one."""
    for company in sorted(companies or [], key=len, reverse=True):
        name = F.replace(name, F.lit(company), F.lit(""))
    out = F.lit(None).cast("string")
    for label, pattern in reversed(KIND_PATTERNS):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def says_passing(name: Column, companies: list[str]) -> Column:
    """Any kind's word but the local one's stands in the name once company names are taken out."""
    for company in sorted(companies, key=len, reverse=True):
        name = F.replace(name, F.lit(company), F.lit(""))
    return name.rlike("|".join(p for label, p in KIND_PATTERNS if label != "각역정차") + "|快特")


def _bound(value: Column, body) -> Column:
    """body(value) with value written once in the plan, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_direction(n: Column) -> Column:
    return F.when(n.rlike(DIRECTION_SIGN), F.regexp_extract(n, DIRECTION_SIGN, 1)).when(n.endswith("方面"), "").otherwise(n)


def _without_suffix(n: Column) -> Column:
    return F.when(n.endswith("駅") & (F.length(n) > 1), F.substring(n, F.lit(1), F.length(n) - 1)).otherwise(n)


def _clean_once(n: Column) -> Column:
    for tail in (BRACKETS, PLATFORM_TAIL):
        n = F.trim(F.regexp_replace(F.trim(n), tail, ""))
    n = F.trim(F.get(F.split(_bound(n, _without_direction), ";"), F.lit(0)))
    for tail in (STATION_TAIL, NUMBER_TAIL):
        n = F.trim(F.regexp_replace(n, tail, ""))
    return F.trim(F.regexp_replace(_bound(n, _without_suffix), KOREAN_TAIL, ""))


def clean_station_name(name: Column, rounds: int = 8) -> Column:
    """A station's name without platform, exit, direction and language tails. The rounds reach the fixpoint of repeated tails; the plan holds one round, whatever their number."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.coalesce(name, F.lit("")), lambda n, _: _clean_once(n))


def base_name(name: Column) -> Column:
    """A line's name without brackets, kind words and outer marks."""
    n = F.regexp_replace(name, r"[(（<〈][^)）>〉]*[)）>〉]", "")
    n = F.regexp_replace(n, "|".join(p for _, p in KIND_PATTERNS), "")
    return F.trim(F.regexp_replace(n, r"\s+", " "), F.lit(" ・･-–—>=→:："))


def line_keys(name: Column) -> Column:
    """The name without brackets and each bracket's content, distinct, without spaces."""
    inner = F.regexp_extract_all(name, F.lit(r"[(（]([^)）]*)[)）]"), 1)
    outer = F.regexp_replace(name, r"[(（][^)）]*[)）]", "")
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(outer), inner), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != ""))


def loose_key(name: Column) -> Column:
    """Lower case without spaces and marks."""
    return F.regexp_replace(F.lower(name), r"[\s\-_.・･()（）]+", "")


def hex_colour(value: Column, names: dict[str, str]) -> Column:
    """#RRGGBB of #rgb, #rrggbb or a colour name; null for anything else."""
    v = F.lower(F.trim(value))
    named = F.lit(None).cast("string")
    for k, c in names.items():
        named = F.when(v == k, c).otherwise(named)
    six = F.upper(F.when(v.startswith("#"), v).otherwise(F.concat(F.lit("#"), v)))
    three = F.regexp_replace(six, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    return F.when(v.rlike("^#?[0-9a-f]{6}$"), six).when(v.rlike("^#?[0-9a-f]{3}$"), three).otherwise(named)


def longest_contained(text: Column, words: list[str]) -> Column:
    """The longest of the words inside text; the first in order on ties."""
    out = F.lit(None).cast("string")
    for w in sorted(words, key=lambda w: (len(w), w)):
        out = F.when(text.contains(w), w).otherwise(out)
    return out


def transliterate(text: Column, chars: dict[str, str], words: dict[str, str], reject: str) -> Column:
    """Words, then single characters replaced; null where a rejected character is in the text."""
    out = text
    for a, b in sorted(words.items(), key=lambda x: -len(x[0])):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "".join(chars), "".join(chars.values()))
    return F.when(~text.rlike(reject), out)


def colour_in_text(text: Column, names: dict[str, str], head: int = 12_000) -> Column:
    """The line colour that the head of a page's template gives, as lower-case #rrggbb; null without one."""
    raw = F.trim(F.regexp_extract(F.substring(text, 1, head), COLOUR_FIELD, 1), F.lit("{}| "))
    found = F.lower(F.regexp_extract(raw, r"#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})\b", 1))
    six = F.when(F.length(found) == 3, F.regexp_replace(found, "(.)(.)(.)", "$1$1$2$2$3$3")).otherwise(found)
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(found != "", F.concat(F.lit("#"), six)).otherwise(F.get(F.array(named[F.lower(raw)]), F.lit(0)))


def made_up_colour(name: Column) -> Column:
    """A colour of fixed lightness and saturation whose hue comes from the name's MD5."""

    def channel(d: Column) -> Column:
        slope = (TONE_HIGH - TONE_LOW) / 60
        return F.floor(255 * F.when(d < 60, TONE_LOW + slope * d).when(d < 180, TONE_HIGH).when(d < 240, TONE_LOW + slope * (240 - d)).otherwise(TONE_LOW))

    hue = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % 360
    return _bound(hue, lambda h: F.format_string("#%02x%02x%02x", channel((h + 120) % 360), channel(h), channel((h + 240) % 360)))


def without_company(name: Column, heads: list[str]) -> Column:
    """name without a company at its start, twice at most, the longest first; a name that is all company stays."""
    pattern = "^(?:" + "|".join(sorted(heads, key=len, reverse=True)) + ")(?=.)[ 　のノ・]*"
    return F.regexp_replace(F.regexp_replace(F.trim(name), pattern, ""), pattern, "")


def line_name_key(name: Column) -> Column:
    """name without brackets, what follows a colon, spaces and marks."""
    head = F.get(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), "[（(].*?[）)]", ""), "[:：]"), F.lit(0))
    return F.regexp_replace(head, r"[\s・･>=→\-–—]", "")


def name_score(a: Column, b: Column, heads: list[str]) -> Column:
    """How alike two line names are: 3 equal keys, 2 equal without companies, 1 the first inside the second, else 0."""
    ka, kb = line_name_key(a), line_name_key(b)
    sa, sb = without_company(ka, heads), without_company(kb, heads)
    inside = kb.contains(ka) | ((sa != "") & sb.contains(sa))
    return F.when((ka == "") | (kb == ""), 0).when(ka == kb, 3).when((sa != "") & (sa == sb), 2).when(inside, 1).otherwise(0)


def place_forms(name: Column) -> Column:
    """Spellings that a place name is looked up by: as written, lower case, without a Japanese or Korean area suffix."""
    n = F.trim(name)
    return F.array_distinct(F.array(n, F.lower(n), F.regexp_replace(n, "[都府県]$", ""), F.regexp_replace(n, "[현부도]$", "")))


def is_service_pattern(name: Column, companies: list[str], heads: list[str]) -> Column:
    """The name is a way of running, not a line: through running, or nothing but a kind once companies are gone."""
    core = F.get(F.split(F.regexp_replace(F.trim(name), "[（(][^）)]*[）)]", ""), "[:：]"), F.lit(0))
    core = without_company(F.regexp_replace(core, "|".join(sorted(companies, key=len, reverse=True)), ""), heads)
    return name.contains("直通運転") | F.trim(core, F.lit(" 　-–—・")).rlike("^(?:" + "|".join(KIND_WORDS) + ")$")
