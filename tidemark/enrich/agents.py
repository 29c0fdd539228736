"""User agents as operating system, browser, device, brand and model.

Requests come from few distinct agents. A batch of rows is reduced to its distinct agents, each of which is parsed once per
worker and remembered; rows only look theirs up.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 1 << 16
FIELDS = ("os", "browser", "device", "brand", "model")

# Patterns of phone models, in families.
PHONES = (
    r"redmi\s*(note|k|[0-9])", r"poco\s*[a-z0-9]", r"mi\s*([0-9]|note|mix|max)", r"galaxy\s*(s|a|m|note)[0-9]", r"galaxy\s*z\s*(fold|flip)", r"huawei\s*(p|mate|nova|y)[0-9]",
    r"honor\s*[0-9a-z]", r"oppo\s*(a|f|find|reno|k)\s*[a-z0-9]", r"vivo\s*(v|y|x|s|t|iqoo)[0-9]", r"iqoo\s*[0-9a-z]", r"oneplus\s*[0-9]", r"one\s*plus\s*[0-9]", r"pixel\s*[0-9]",
    r"realme\s*[0-9a-z]", r"moto\s*(g|e|x|z|edge|razr)", r"motorola\s*(edge|razr)", r"nokia\s*[0-9]", r"xperia\s*[0-9a-z]", r"nothing\s*phone",
)
# Model codes of mobile devices and tablets, and keywords of either.
SAMSUNG_PHONE, SAMSUNG_TABLET, LG_PHONE = r"sm-[abdefgjmnrwz][0-9]+", r"sm-t[0-9]+", r"lg-[a-z0-9]+"
MOBILE = (
    "avantgo", "bada/", "blackberry", "blazer", "compal", "elaine", "fennec", "hiptop", "iemobile", "iphone", "ipod", "iris", "kindle", "lge ",
    "maemo", "midp", "mmp", "netfront", "opera mobi", "opera mini", "palm", "phone", "pixi/", "pre/", "plucker", "pocket", "psp", "series40",
    "series60", "symbian", "treo", "up.browser", "up.link", "vodafone", "wap", "windows ce", "xda", "xiino",
)
MOBILE_WORDED = r"(android|bb\d+|meego).+mobile|mobile.+firefox"
TABLET = ("tablet", "ipad", "xoom", "sch-i800", "kindle", "silk", "playbook")
# The word each phone pattern begins with: without one of them no pattern can match, and finding them is cheap.
PHONE_WORDS = tuple(dict.fromkeys(re.match(r"[a-z]+", p).group() for p in PHONES))
# Brands by pattern, the first match counts.
BRANDS = (
    (r"xiaomi|redmi|poco", "Xiaomi"), (r"samsung|galaxy", "Samsung"), (r"huawei", "Huawei"), (r"honor", "Honor"), (r"oppo", "OPPO"), (r"vivo|iqoo", "Vivo"),
    (r"oneplus|one\s*plus", "OnePlus"), (r"google|pixel", "Google"), (r"realme", "Realme"), (r"motorola|moto\s", "Motorola"), (r"nokia", "Nokia"), (r"sony|xperia", "Sony"),
    (r"nothing", "Nothing"), (r"\bapple\b(?!webkit)|\biphone\b|\bipad\b", "Apple"), (r"lg[- ]", "LG"), (r"zte", "ZTE"), (r"lenovo", "Lenovo"), (r"asus", "ASUS"), (r"tcl", "TCL"),
)
# Browser and system families, the first match counts.
BROWSERS = (
    (r"Edg(e|A|iOS)?/", "Edge"), (r"OPR/|Opera", "Opera"), (r"SamsungBrowser/", "Samsung Internet"), (r"YaBrowser/", "Yandex"), (r"Vivaldi/", "Vivaldi"),
    (r"UCBrowser/", "UCBrowser"), (r"MiuiBrowser/", "MIUI Browser"), (r"HuaweiBrowser/", "Huawei Browser"), (r"DuckDuckGo/", "DuckDuckGo"), (r"FBAN/|FBAV/", "Facebook"),
    (r"Instagram", "Instagram"), (r"MicroMessenger/", "WeChat"), (r"\bLine/", "Line"), (r"GSA/", "GSA"), (r"Electron/", "Electron"), (r"Silk/", "Silk"),
    (r"HeadlessChrome/", "Chrome Headless"), (r"Waterfox/", "Waterfox"), (r"PaleMoon/", "Pale Moon"), (r"FxiOS/|Firefox/", "Firefox"), (r"CriOS/|Chrome/", "Chrome"),
    (r"Version/.*Mobile.*Safari/", "Mobile Safari"), (r"Version/.*Safari/", "Safari"), (r"MSIE |Trident/", "IE"), (r"Konqueror", "Konqueror"),
)
SYSTEMS = (
    (r"Windows Phone", "Windows Phone"), (r"PlayStation", "PlayStation"), (r"Xbox", "Xbox"), (r"Nintendo", "Nintendo"), (r"KAIOS", "KAIOS"), (r"HarmonyOS", "HarmonyOS"),
    (r"Tizen", "Tizen"), (r"Web0S|webOS", "webOS"), (r"BlackBerry|BB10", "BlackBerry"), (r"iPhone|iPad|iPod|\biOS\b", "iOS"), (r"Android", "Android"), (r"Windows", "Windows"),
    (r"Mac OS X|Macintosh", "macOS"), (r"CrOS", "Chrome OS"), (r"FreeBSD", "FreeBSD"), (r"OpenBSD", "OpenBSD"), (r"Linux|X11", "Linux"),
)


def _compiled(table: Sequence[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(pattern.lower(), re.ASCII), name) for pattern, name in table]


_BRANDS, _BROWSERS, _SYSTEMS = _compiled(BRANDS), _compiled(BROWSERS), _compiled(SYSTEMS)
_PHONES, _WORDED = re.compile("|".join(PHONES), re.ASCII), re.compile(MOBILE_WORDED, re.ASCII)
_CODES = [re.compile(code, re.ASCII) for code in (SAMSUNG_PHONE, SAMSUNG_TABLET, LG_PHONE)]
_NAME_VERSION = re.compile(r"[^/]+/[\d.]+", re.ASCII)
_APP = {name: re.compile(rf"{name}=([^;)]+)", re.I) for name in ("Model", "Manufacturer")}


def _first(lower: str, table: list[tuple[re.Pattern, str]]) -> str | None:
    return next((name for pattern, name in table if pattern.search(lower)), None)


def _app_field(ua: str, name: str) -> str | None:
    """``Model`` or ``Manufacturer`` in app-style agents."""
    found = _APP[name].search(ua)
    return found.group(1).strip(" ") or None if found else None


def device_of(lower: str, model: str, legacy_prefixes: Sequence[str] = ()) -> str:
    """mobile, tablet or desktop. Known phone models decide first, then model codes, keywords and, last, Android. ``legacy_prefixes`` are
    patterns for the first four characters of feature-phone agents."""
    samsung_phone, samsung_tablet, lg_phone = (code.search(lower) for code in _CODES)
    phone = _PHONES.search(model) or (any(w in lower for w in PHONE_WORDS) and _PHONES.search(lower))
    if phone or samsung_phone:
        return "mobile"
    if samsung_tablet:
        return "tablet"
    old = any(re.search(p, lower[:4]) for p in legacy_prefixes)
    if lg_phone or any(w in lower for w in MOBILE) or _WORDED.search(lower) or old:
        return "mobile"
    if any(w in lower for w in TABLET):
        return "tablet"
    return "mobile" if "android" in lower and "mobile" not in lower else "desktop"


@lru_cache(REMEMBERED)
def parsed(ua: str, legacy_prefixes: tuple[str, ...] = ()) -> dict:
    """Fields of an agent; what is unknown is null. An agent that is missing, a lone name/version pair, or not recognisable at all
    belongs to a server."""
    lower = ua.lower()
    system, browser = _first(lower, _SYSTEMS), _first(lower, _BROWSERS)
    model, maker = _app_field(ua, "Model"), _app_field(ua, "Manufacturer")
    if _NAME_VERSION.fullmatch(ua) or not (system or browser or model or maker):
        return {"is_server": True}
    named = f"{lower} {model.lower()}" if model else lower
    return {"os": system, "browser": browser, "device": device_of(lower, (model or "").lower(), legacy_prefixes),
            "brand": maker or _first(named, _BRANDS), "model": model, "is_server": False}


def agent_fields(legacy_prefixes: Sequence[str] = ()):
    """A column function from agent texts to structs of their fields."""
    legacy, kind = tuple(legacy_prefixes), pa.struct([(f, pa.string()) for f in FIELDS] + [("is_server", pa.bool_())])

    @F.arrow_udf(", ".join(f"{f} string" for f in FIELDS) + ", is_server boolean")
    def fields(agents: pa.Array) -> pa.Array:
        coded = agents.dictionary_encode()
        return pa.array([parsed(a, legacy) for a in coded.dictionary.to_pylist()], kind).take(coded.indices)

    return fields


def with_agent(df: DataFrame, ua: str = "user_agent", overrides: str | None = None, name: str = "agent",
               legacy_prefixes: Sequence[str] = ()) -> DataFrame:
    """Add a struct of os, browser, device, brand, model and is_server; non-blank ``__os``, ``__browser`` … entries of the overrides map
    win, but not for servers."""
    rows = df.withColumn("_agent_fields", agent_fields(legacy_prefixes)(F.coalesce(F.col(ua), F.lit(""))))
    found = {f: F.col("_agent_fields")[f] for f in FIELDS}
    if overrides:
        found = {f: F.coalesce(F.when(F.col(overrides)[f"__{f}"] != "", F.col(overrides)[f"__{f}"]), v) for f, v in found.items()}
    server = F.col("_agent_fields")["is_server"]
    fields = [F.when(server, F.lit("server" if f == "device" else "")).otherwise(F.coalesce(v, F.lit(""))).alias(f) for f, v in found.items()]
    return rows.withColumn(name, F.struct(*fields, server.alias("is_server"))).drop("_agent_fields")
