"""Names, kinds, keys, colours and table text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, tags
from ..registry import query
from ..sources.bindings import Tables

COMPANIES = ["智頭急行", "北大阪急行電鉄", "京浜急行電鉄"]
SAMPLES = [
    "特急はちおうじ", "通勤快速 高尾", "新快速", "智頭急行智頭線", "急行だいせん", "富士急行線", "準急 多摩湖", "普通 大月", "Local train", "中央本線", "Limited Express Haruka", "快速マリンライナー",
]
STATIONS = ["柘植駅1番のりば", "北千住01", "一乗寺駅八瀬比叡山口・鞍馬方面", "鞍馬方面", "鷹ノ巣;鷹巣", "谷上駅4･", "하카타 역", "도스 시", "東京駅(丸の内)", "東京", "上野のりばのりば", "駅"]
CLEANED = ["柘植", "北千住", "一乗寺", "", "鷹ノ巣", "谷上", "하카타", "도스", "東京", "東京", "上野", "駅"]


def _picked(t: Tables, values: list[str]) -> DataFrame:
    """Each stop with one of the values, by its number."""
    return t.stops.select("stop", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("stop") % len(values) + 1).cast("int")).alias("v"))


def _sql_picked(values: list[str]) -> str:
    return "(SELECT stop, [" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(stop % {len(values)} + 1 AS INT)] AS v FROM stops)"


def _sql_kind(v: str) -> str:
    text = v
    for c in sorted(COMPANIES, key=len, reverse=True):
        text = f"replace({text}, '{c}', '')"
    cases = []
    for label, p in names.KIND_PATTERNS:  # RE2 has no lookahead: the banned endings are blanked first
        if "(?!" in p:
            cases.append(f"WHEN contains(regexp_replace({text}, '急行(電鉄|鉄道|線)', '', 'g'), '急行') THEN '{label}'")
        else:
            cases.append(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'")
    return f"CASE {' '.join(cases)} END"


def _sql_without(text: str) -> str:
    for c in sorted(COMPANIES, key=len, reverse=True):
        text = f"replace({text}, '{c}', '')"
    return text


@query("p14_kind_of", f"SELECT stop, {_sql_kind('v')} AS kind FROM {_sql_picked(SAMPLES)}")
def p14(t: Tables) -> DataFrame:
    """Kind of service by ordered patterns, company names taken out."""
    return _picked(t, SAMPLES).select("stop", names.kind_of(F.col("v"), COMPANIES).alias("kind"))


SERVICES = ["新快速", "相鉄直通線", "東武準急", "京王線", "直通運転 A - B", "JR東日本特急", "快速 (土休日)：高尾", "富士急行線", "小田急の通勤急行", "各停"]
OWNERS, HEADS = ["JR東日本", "東京メトロ"], ["東武", "相鉄", "小田急", "京王", "京王電鉄"]
STRIP_HEAD = "^(?:京王電鉄|小田急|東武|相鉄|京王)[ 　のノ・]*(.+)$"
CORE = f"trim(regexp_replace(regexp_replace(regexp_replace(string_split_regex(regexp_replace(v, '[（(][^）)]*[)）]', '', 'g'), '[:：]')[1], 'JR東日本|東京メトロ', '', 'g'), '{STRIP_HEAD}', '\\1'), '{STRIP_HEAD}', '\\1'))"


@query("p15_passing", f"SELECT stop, regexp_matches({_sql_without('v')}, '特急|Limited Express|快速|特快|通勤急行|通勤準急|区間急行|マリンライナー|急行($|[^電鉄線])|準急|快特') AS passing FROM {_sql_picked(SAMPLES)}")
def p15(t: Tables) -> DataFrame:
    """Names that say that a train passes stations: any kind but the local one; company names don't count."""
    return _picked(t, SAMPLES).select("stop", names.says_passing(F.col("v"), COMPANIES).alias("passing"))


@query("p15_service_pattern", f"SELECT stop, contains(v, '直通運転') OR regexp_matches({CORE}, '^(?:{'|'.join(names.KIND_WORDS)})$') AS pattern FROM {_sql_picked(SERVICES)}")
def p15_pattern(t: Tables) -> DataFrame:
    """Names that are a way of running and not a line."""
    return _picked(t, SERVICES).select("stop", names.is_service_pattern(F.col("v"), OWNERS, HEADS).alias("pattern"))


NOT_TRAIN = "(coalesce(bus = 'yes', false) OR coalesce(highway = 'bus_stop', false) OR coalesce(ferry = 'yes', false) OR aerialway IS NOT NULL OR coalesce(amenity IN ('bus_station', 'ferry_terminal'), false))"


@query("p11_not_train", f"SELECT stop, {NOT_TRAIN} AS not_train FROM tagged_nodes")
def p11(t: Tables) -> DataFrame:
    """Stops of buses, ferries and cable cars by any of their tags."""
    return t.tagged_nodes.select("stop", tags.not_train().alias("not_train"))


@query(
    "p12_station_nodes",
    f"SELECT stop, coalesce(railway IN ('station', 'halt') AND coalesce(usage, '') NOT IN ('tourism', 'training', 'military', 'test', 'industrial') AND monorail IS DISTINCT FROM 'yes' AND NOT ends_with(name, '信号場'), false) AS passenger FROM tagged_nodes WHERE railway IN ('station', 'halt', 'tram_stop') OR (public_transport IN ('station', 'stop_position') AND NOT {NOT_TRAIN})",
)
def p12(t: Tables) -> DataFrame:
    """Nodes that lines stop at, and which of them may fill a gap of a line."""
    return t.tagged_nodes.where(tags.stop_node()).select("stop", tags.passenger_station().alias("passenger"))


@query("x01_clean_station_name", f"SELECT stop, {('[' + ', '.join(repr(c) for c in CLEANED) + ']')}[CAST(stop % {len(CLEANED)} + 1 AS INT)] AS name FROM stops")
def x01(t: Tables) -> DataFrame:
    """Cleaned station names; the oracle holds the expected results."""
    return _picked(t, STATIONS).select("stop", names.clean_station_name(F.col("v")).alias("name"))


LINES = ["中央線(快速)", "Chuo Line (Rapid)", "山手線（内回り）", "Tokaido  Main", "東海道本線"]


@query("x02_base_name", f"SELECT stop, trim(regexp_replace(regexp_replace(v, '[(（][^)）]*[)）]', '', 'g'), '\\s+', ' ', 'g')) AS base FROM {_sql_picked(LINES)}")
def x02(t: Tables) -> DataFrame:
    return _picked(t, LINES).select("stop", names.base_name(F.col("v")).alias("base"))


@query("x03_line_keys", f"SELECT stop, list_filter(list_distinct(list_transform(list_concat([regexp_replace(v, '[(（][^)）]*[)）]', '', 'g')], regexp_extract_all(v, '[(（]([^)）]*)[)）]', 1)), lambda x: regexp_replace(x, '\\s+', '', 'g'))), lambda x: x <> '')[1] AS key, len(regexp_extract_all(v, '[(（]([^)）]*)[)）]', 1)) + 1 AS n FROM {_sql_picked(['中央線', 'Tokaido  Main', '東海道本線'])}")
def x03(t: Tables) -> DataFrame:
    d = _picked(t, ["中央線", "Tokaido  Main", "東海道本線"]).withColumn("k", names.line_keys(F.col("v")))
    return d.select("stop", F.get("k", F.lit(0)).alias("key"), F.size("k").cast("bigint").alias("n"))


@query("x05_loose_key", "SELECT stop, regexp_replace(lower(name), '[\\s\\-_.・･()（）]+', '', 'g') || '|' || operator AS key FROM stops")
def x05(t: Tables) -> DataFrame:
    """Normalised name with its operator."""
    return t.stops.select("stop", F.concat_ws("|", names.loose_key(F.col("name")), "operator").alias("key"))


@query("x06_operator_in_name", "SELECT stop, CASE WHEN contains(name, 'widget') THEN 'widget' WHEN contains(name, 'gizmo') THEN 'gizmo' WHEN contains(name, 'gear') THEN 'gear' WHEN contains(name, 'ring') THEN 'ring' END AS found FROM stops")
def x06(t: Tables) -> DataFrame:
    """The longest known operator inside a name."""
    return t.stops.select("stop", names.longest_contained(F.col("name"), ["ring", "gear", "gizmo", "widget"]).alias("found"))


@query("x07_strip_lead", "SELECT stop, CASE WHEN starts_with(name, 'small ') THEN substr(name, 7) WHEN starts_with(name, 'red ') THEN substr(name, 5) ELSE name END AS name FROM stops")
def x07(t: Tables) -> DataFrame:
    """A leading word taken off, the longest first."""
    return t.stops.select("stop", F.regexp_replace("name", "^(small|red) (?=.)", "").alias("name"))


@query("x08_disambiguate", "SELECT stop, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || operator || ')' ELSE name END AS title FROM stops")
def x08(t: Tables) -> DataFrame:
    """Duplicate titles get their operator; counted by an aggregate, as a window would sort all rows of a name."""
    n = t.stops.groupBy("name").agg(F.count("*").alias("n"))
    return t.stops.join(n, "name").select("stop", F.when(F.col("n") > 1, F.concat("name", F.lit(" ("), "operator", F.lit(")"))).otherwise(F.col("name")).alias("title"))


@query("x09_transliterate", f"SELECT stop, CASE WHEN NOT regexp_matches(v, '[ぁ-んァ-ン]') THEN translate(replace(v, '新宿', '新·宿'), '駅東', '站东') END AS zh FROM {_sql_picked(['東京駅', '新宿駅', 'さいたま', '横浜'])}")
def x09(t: Tables) -> DataFrame:
    """Words and characters mapped; kana gives null (Z28 builds the character table)."""
    return _picked(t, ["東京駅", "新宿駅", "さいたま", "横浜"]).select("stop", names.transliterate(F.col("v"), {"駅": "站", "東": "东"}, {"新宿": "新·宿"}, "[ぁ-んァ-ン]").alias("zh"))


COLOURS = ["#fff", "00ff7F", "red", " #12aBcd ", "nonsense", "#12345"]


@query("x10_hex_colour", f"SELECT stop, ['#FFFFFF', '#00FF7F', '#FF0000', '#12ABCD', NULL, NULL][CAST(stop % {len(COLOURS)} + 1 AS INT)] AS colour FROM stops")
def x10(t: Tables) -> DataFrame:
    return _picked(t, COLOURS).select("stop", names.hex_colour(F.col("v"), {"red": "#FF0000", "blue": "#0000FF"}).alias("colour"))


FIELDS = ["#0F8", "#12aBcd", "{{red}}", "Skyblue", "#12345", "", "[[#09c]] & #fff"]
NAMED = {"red": "#ff0000", "skyblue": "#87ceeb", "navy": "#000080"}
WIKI_SQL = f"SELECT stop, '{{{{鉄道路線|路線名=' || stop || chr(10) || CASE WHEN stop % 2 = 0 THEN '|路線色 = ' ELSE '|ラインカラー=' END || v || chr(10) || '|開業=1901}}}}' AS text FROM {_sql_picked(FIELDS)}"
FIELD_SQL = "trim(regexp_extract(text, '(?:路線色|ラインカラー|ラインの色)\\s*=\\s*([^\\n|}]+)', 1), '{}| ')"


@query("x11_colour_in_text", f"SELECT stop, CASE WHEN length(h) = 6 THEN '#' || h WHEN length(h) = 3 THEN '#' || h[1] || h[1] || h[2] || h[2] || h[3] || h[3] WHEN lower(raw) = 'red' THEN '#ff0000' WHEN lower(raw) = 'skyblue' THEN '#87ceeb' WHEN lower(raw) = 'navy' THEN '#000080' END AS colour FROM (SELECT stop, raw, lower(regexp_extract(raw, '#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{3}})\\b', 1)) AS h FROM (SELECT stop, {FIELD_SQL} AS raw FROM ({WIKI_SQL})))")
def x11(t: Tables) -> DataFrame:
    """The line colour that a page's template gives: hex of three or six digits, or a colour's name."""
    text = F.concat(F.lit("{{鉄道路線|路線名="), F.col("stop").cast("string"), F.when(F.col("stop") % 2 == 0, "\n|路線色 = ").otherwise("\n|ラインカラー="), "v", F.lit("\n|開業=1901}}"))
    return _picked(t, FIELDS).select("stop", names.colour_in_text(text, NAMED).alias("colour"))


@query(
    "x12_station_tables",
    "SELECT line, kind, k AS column, pos, 'S' || stop || '駅' AS station FROM (SELECT line, stop, row_number() OVER (PARTITION BY line ORDER BY stop) + 1 AS pos FROM stops), (VALUES ('特急', 0, 3), ('急行', 1, 2), ('特急', 2, 5)) AS v(kind, k, every) WHERE stop % every = 0",
)
def x12(t: Tables) -> DataFrame:
    """Stopping patterns read back from station tables as wiki pages mark them up."""
    from ..functions.wikitable import stopping_patterns

    mark = lambda every, yes, no: F.when(F.col("stop") % every == 0, yes).otherwise(no)
    link = F.when(F.col("stop") % 4 == 0, F.format_string("[[S%d駅]]", "stop")).otherwise(F.format_string("[[町 (%d)|S%d駅]]", "stop", "stop"))
    first = F.when(F.col("stop") % 7 == 0, F.concat(F.lit('| style="width:1em"|'), link)).otherwise(F.concat(F.lit("|"), link))
    row = F.concat(first, F.lit("\n|"), mark(3, "●", "｜"), F.lit("||"), mark(2, "○", "レ"), F.lit("||"), mark(5, "▲", "｜"))
    rows = F.array_sort(F.collect_list(F.struct("stop", row.alias("r"))))
    head = "[[#駅一覧]]\n== 駅一覧 ==\n{| class=\"wikitable\"\n|-\n!駅名||特急||{{縦書き|急行}}\n!特急〈A〉\n|-\n"
    pages = t.stops.groupBy("line").agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda x: x["r"]), "\n|-\n"), F.lit("\n|}\nend")).alias("text"))
    return stopping_patterns(pages, "line", "text")


TITLES, OTHERS = ["東武本線", "東武 本線", "相鉄本線", "京王線 (新線)", "本線：支線", "", "小田急の江ノ島線"], ["本線", "東武本線", "京王電鉄京王線", "江ノ島線", "本線・支線 - A", "相鉄直通線", "京王線"]


def _sql_line_key(v: str) -> str:
    return f"regexp_replace(string_split_regex(regexp_replace({v}, '[（(].*?[）)]', '', 'g'), '[:：]')[1], '[\\s・･>=→\\-–—]', '', 'g')"


def _sql_headless(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '{STRIP_HEAD}', '\\1'), '{STRIP_HEAD}', '\\1')"


@query(
    "x13_name_score",
    f"""WITH k AS (SELECT x.stop, {_sql_line_key("x.v")} AS a, {_sql_line_key("y.v")} AS b FROM {_sql_picked(TITLES)} AS x JOIN (SELECT stop, v FROM {_sql_picked(OTHERS).replace("stop % 7", "(stop // 7) % 7")}) AS y ON x.stop = y.stop), s AS (SELECT *, {_sql_headless("a")} AS sa, {_sql_headless("b")} AS sb FROM k)
SELECT stop, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 3 WHEN sa <> '' AND sa = sb THEN 2 WHEN contains(b, a) OR (sa <> '' AND contains(sb, sa)) THEN 1 ELSE 0 END AS score FROM s""",
)
def x13(t: Tables) -> DataFrame:
    """How alike a page's title and a line's name are, company names aside."""
    other = F.element_at(F.array(*[F.lit(v) for v in OTHERS]), (F.floor(F.col("stop") / 7) % 7 + 1).cast("int"))
    return _picked(t, TITLES).select("stop", names.name_score(F.col("v"), other, HEADS).alias("score"))


# Fixed values: (code, Japanese, Korean, English) of areas.
AREAS = [(12, "千葉県", "지바", "Chiba"), (13, "東京都", "도쿄", "Tokyo"), (14, "神奈川県", "가나가와", "Kanagawa"), (26, "京都府", "교토", "Kyoto"), (27, "大阪府", "오사카", "Osaka")]
ASKED = ["東京", " Tokyo", "도쿄도", "大阪府", "osaka", "오사카부", "교토", "Atlantis", "千葉", "神奈川県"]
AREA_SQL = ", ".join(f"({c}, '{ja}', '{ko}', '{en}')" for c, ja, ko, en in AREAS)


@query(
    "x15_resolve_forms",
    f"""WITH a AS (SELECT code, unnest(list_distinct([ja, regexp_replace(ja, '[都府県]$', ''), ko, lower(en)])) AS form FROM (VALUES {AREA_SQL}) AS v(code, ja, ko, en)),
w AS (SELECT s.stop, s.line, unnest(list_distinct([trim(v), lower(trim(v)), regexp_replace(trim(v), '[都府県]$', ''), regexp_replace(trim(v), '[현부도]$', '')])) AS form FROM {_sql_picked(ASKED)} AS p JOIN stops AS s ON s.stop = p.stop)
SELECT line, 'custom_' || string_agg(lpad(CAST(code AS VARCHAR), 2, '0'), '_' ORDER BY code) AS combo FROM (SELECT DISTINCT line, code FROM w JOIN a USING (form)) GROUP BY line""",
)
def x15(t: Tables) -> DataFrame:
    """Area names in any spelling resolved to codes by an equi-join on forms; the id of each line's combination."""
    area = t.spark.createDataFrame(AREAS, "code int, ja string, ko string, en string")
    forms = area.select("code", F.explode(F.array_distinct(F.array("ja", F.regexp_replace("ja", "[都府県]$", ""), "ko", F.lower("en")))).alias("form"))
    asked = _picked(t, ASKED).join(t.stops.select("stop", "line"), "stop").select("line", F.explode(names.place_forms(F.col("v"))).alias("form"))
    codes = asked.join(forms, "form").groupBy("line").agg(F.array_sort(F.collect_set("code")).alias("c"))
    return codes.select("line", F.concat(F.lit("custom_"), F.array_join(F.transform("c", lambda c: F.lpad(c.cast("string"), 2, "0")), "_")).alias("combo"))


def _sql_channel(shift: int) -> str:
    d, low, high = f"((h + {shift}) % 360)", f"{names.TONE_LOW!r}e0", f"{names.TONE_HIGH!r}e0"
    return f"CAST(floor(255 * CASE WHEN {d} < 60 THEN {low} + ({high} - {low}) / 60 * {d} WHEN {d} < 180 THEN {high} WHEN {d} < 240 THEN {low} + ({high} - {low}) / 60 * (240 - {d}) ELSE {low} END) AS INTEGER)"


@query("m12_made_up_colour", f"SELECT stop, printf('#%02x%02x%02x', {_sql_channel(120)}, {_sql_channel(0)}, {_sql_channel(240)}) AS colour FROM (SELECT stop, CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % 360 AS h FROM stops)")
def m12(t: Tables) -> DataFrame:
    """A colour made from a name: the hue from its hash, lightness and saturation fixed."""
    return t.stops.select("stop", names.made_up_colour(F.col("name")).alias("colour"))


LINE_TABLE, NAME_TABLE = {"Brand#11|3": "#aa0000", "Brand#23|9": "0a0"}, {"3": "#123456", "17": "abc"}


@query(
    "x16_colour_chain",
    """WITH c AS (SELECT stop, CASE operator || '|' || line WHEN 'Brand#11|3' THEN '#AA0000' WHEN 'Brand#23|9' THEN '#00AA00' END AS a, CASE line WHEN 3 THEN '#123456' WHEN 17 THEN '#AABBCC' END AS b, CASE WHEN size % 10 = 1 THEN '#' || printf('%06d', size * 1000) END AS c, CASE WHEN size % 10 = 2 THEN '#BB22' || printf('%02d', size) END AS d FROM stops)
SELECT stop, coalesce(a, b, c, d, '#888888') AS colour FROM c""",
)
def x16(t: Tables) -> DataFrame:
    """A line's colour: the table's entry for line and company, for the line, the tags color and colour, else grey. Values that are no colour are passed over."""
    pick = lambda table, key: F.get(F.array(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]), F.lit(0))
    color = F.when(F.col("size") % 10 == 1, F.lpad((F.col("size") * 1000).cast("string"), 6, "0")).when(F.col("size") % 10 == 3, "none")
    colour = F.when(F.col("size") % 10 == 2, F.concat(F.lit("#bb22"), F.lpad(F.col("size").cast("string"), 2, "0")))
    found = [pick(LINE_TABLE, F.concat_ws("|", "operator", "line")), pick(NAME_TABLE, F.col("line").cast("string")), color, colour]
    return t.stops.select("stop", F.coalesce(*[names.hex_colour(v, {}) for v in found], F.lit("#888888")).alias("colour"))


@query("z02_pattern_of_event", "SELECT trip, seq, CASE WHEN pattern = -1 THEN '' ELSE 'pattern ' || pattern END AS pattern FROM events")
def z02(t: Tables) -> DataFrame:
    return t.events.select("trip", "seq", F.when(F.col("pattern") == -1, "").otherwise(F.concat(F.lit("pattern "), F.col("pattern").cast("string"))).alias("pattern"))


@query("z19_can_borrow", "SELECT DISTINCT a.operator AS a, b.operator AS b FROM (SELECT DISTINCT operator FROM stops) AS a JOIN (SELECT DISTINCT operator FROM stops) AS b ON a.operator < b.operator AND regexp_extract(a.operator, '(\\d)$', 1) = regexp_extract(b.operator, '(\\d)$', 1)")
def z19(t: Tables) -> DataFrame:
    """Operators that may lend each other colours: the same group, by an equi-join on it."""
    o = t.stops.select("operator").distinct().withColumn("g", F.regexp_extract("operator", r"(\d)$", 1))
    return o.select(F.col("operator").alias("a"), "g").join(o.select(F.col("operator").alias("b"), "g"), "g").where("a < b").select("a", "b")


@query("z22_prefix", "SELECT stop, split_part(operator, '#', 1) AS prefix, split_part(operator, '#', 2) AS rest FROM stops")
def z22(t: Tables) -> DataFrame:
    """The part of an id before and after its mark."""
    return t.stops.select("stop", F.split_part("operator", F.lit("#"), F.lit(1)).alias("prefix"), F.split_part("operator", F.lit("#"), F.lit(2)).alias("rest"))


@query("z24_neighbour_regions", "SELECT DISTINCT a.operator AS a, b.operator AS b FROM stops AS a JOIN stops AS b ON a.line = b.line AND a.operator < b.operator")
def z24(t: Tables) -> DataFrame:
    """Regions that share a part."""
    s = t.stops.select("line", "operator").distinct()
    return s.select("line", F.col("operator").alias("a")).join(s.select("line", F.col("operator").alias("b")), "line").where("a < b").select("a", "b").distinct()


@query("z28_characters", "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(name, '')) AS c FROM stops) GROUP BY c")
def z28(t: Tables) -> DataFrame:
    return t.stops.select(F.explode(F.split("name", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
