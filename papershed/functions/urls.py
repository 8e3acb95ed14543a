"""URLs: which material one names, which may be opened, which picture or player one shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papershed.functions.text import let

# Parameters that only say how a reader came, everywhere, by beginning, and on some sites; sites on which ref picks the content.
TRACKING = ("ref_src", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "_hsenc", "_hsmi", "mkt_tok", "yclid", "spm", "share")
TRACKING_START = "utm_"
SITE_TRACKING = {"s": ("x.com", "twitter.com"), "si": ("youtube.com", "youtu.be", "spotify.com")}
REF_IS_CONTENT = ("github.com", "gitlab.com")
# Hosts and address ranges that aren't public.
PRIVATE_NAMES = r"^localhost$|\.localhost$|\.local$|\.internal$"
PRIVATE_V4 = r"^(?:0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+$|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+$"
PRIVATE_V6 = r"^\[(?:::1\]|fe80|fc|fd|::ffff:)"
LONGEST_LINK = 8192

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host_of(url: Column) -> Column:
    """The host in lower case, without credentials and port; an IPv6 address keeps its brackets."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def on_site(host: Column, *sites: str) -> Column:
    found = F.lit(False)
    for site in sites:
        found |= (host == site) | host.endswith(f".{site}")
    return found


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; what is kept stays as written, scheme and host in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    parts = F.struct(
        bare.alias("bare"), F.regexp_extract(bare, r"^([^?]*)", 1).alias("base"), host_of(bare).alias("host"), origin_of(bare).alias("origin"),
        F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&").alias("params"),
    )
    return let(parts, _canonical)


def _canonical(p: Column) -> Column:
    def tracking(name: Column) -> Column:
        found = name.isin(*TRACKING) | F.startswith(name, F.lit(TRACKING_START)) | ((name == "ref") & ~on_site(p["host"], *REF_IS_CONTENT))
        for short, sites in SITE_TRACKING.items():
            found |= (name == short) & on_site(p["host"], *sites)
        return found

    def joined(kept: Column) -> Column:
        query = F.array_join(kept, "&")
        tail = F.when(F.size(kept) == F.size(p["params"]), F.substr(p["bare"], F.char_length(p["base"]) + 1)).when(query == "", "").otherwise(F.concat(F.lit("?"), query))
        path = F.substr(p["base"], F.char_length(p["origin"]) + 1)
        rooted = F.when((path == "") & (p["origin"] != ""), "/").otherwise(path)
        return F.concat(F.when(p["origin"] != "", p["origin"]).otherwise(""), rooted, tail)

    return let(F.filter(p["params"], lambda pair: ~tracking(F.substring_index(pair, "=", 1))), joined)


def same_site(a: Column, b: Column) -> Column:
    """Hosts that are equal but for www., or one a subdomain of the other."""
    x, y = (F.regexp_replace(h, r"^www\.", "") for h in (a, b))
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def resolved(href: Column, page: Column) -> Column:
    """A link as an absolute URL: absolute, scheme-relative, rooted, or relative to the page's folder."""
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.concat(origin_of(page), F.coalesce(F.nullif(F.regexp_extract(path_of(page), r"^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin_of(page), href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(page, "#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def canonical_link(href: Column, page: Column) -> Column:
    """A declared canonical link as another name of its page: of the same site, not its home page, not the page itself; else null."""
    link = resolved(href, page)
    fine_of = lambda link: link.rlike(r"^(?i)https?://") & ~path_of(link).isin("", "/") & same_site(host_of(link), host_of(page))
    return let(F.struct(link.alias("link"), canonical_url(link).alias("named")), lambda c: F.when(fine_of(c["link"]) & (c["named"] != canonical_url(page)), c["named"]))


def is_public_url(url: Column) -> Column:
    """http(s) without credentials, to a host that isn't local or private."""
    host = host_of(url)
    private = host.rlike(PRIVATE_NAMES) | host.rlike(PRIVATE_V4) | host.rlike(PRIVATE_V6)
    return url.rlike(r"^(?i)https?://[^/?#@]+(?:[/?#]|$)") & (host != "") & ~private


def safe_link(url: Column) -> Column:
    """A link that a reader may be sent to, scheme and host in lower case: http(s) without credentials, or mailto; else null."""
    plain = (F.char_length(url) <= LONGEST_LINK) & ~url.rlike(r"[\x00-\x1f\x7f]")
    web = url.rlike(r"^(?i)https?://[^/?#@]+(?:[/?#]|$)")
    rooted = F.when(path_of(url) == "", F.concat(origin_of(url), F.lit("/"), F.substr(url, F.char_length(origin_of(url)) + 1))).otherwise(F.concat(origin_of(url), F.substr(url, F.char_length(origin_of(url)) + 1)))
    return F.when(plain & web, rooted).when(plain & url.rlike("^(?i)mailto:"), F.concat(F.lit("mailto:"), F.substr(url, F.lit(8))))


def slug(url: Column) -> Column:
    """Host and path in lower case, words parted by hyphens, 80 characters at most."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(url, r"^[a-zA-Z]+://(www\.)?|[?#].*$", "")), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+", ""), 1, 80), "-+$", "")


# Endings of picture files, endings of names that say a size or variant, names that say nothing, query parameters that carry a picture.
EXTENSIONS = r"(?:\.(?:png|jpe?g|gif|webp|avif|jxl|svg|bmp|tiff?|ico|heic|heif))+$"
SIZES = r"(?:(?<=.)(?:[-_]\d{1,5}x\d{1,5}|@\d(?:\.\d+)?x|[-_]\d(?:\.\d+)?x|-scaled|[-_]thumb(?:nail)?|-e\d{10,13}|=[swh]\d+(?:-[a-z0-9]+)*))+$"
GENERIC = (
    "", "image", "img", "images", "photo", "picture", "default", "index", "thumbnail", "thumb", "download", "file", "original", "full", "large", "medium", "small", "unnamed", "media", "fetch",
)
CARRIES = "url|href|src|u|image"
#: Segments of a path that only say how a picture is served: options joined by commas, or a version.
OPTION = r"(?:\$s_![^!]*!|[a-z]{1,4}_[\w.:!%-]+|[a-z]+=[\w.:%-]+)"
TRANSFORMS = rf"^(?:(?:resize|format|fit|crop|quality|q|w|h):.*|{OPTION}(?:,{OPTION})*|v\d)$"


def decoded_path(path: Column) -> Column:
    """A path with its escapes decoded; as it is if one is broken."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def inner_image(url: Column) -> Column:
    """The picture behind a proxy URL that carries it in its path or in ``url=``, up to four levels."""
    def inner(url: Column) -> Column:
        in_path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+/[^?#]*?(https?(?:://?|%3a)[^?#]*)", 1)
        in_query = F.regexp_extract(url, rf"[?&](?:{CARRIES})=((?i:https?)(?:%3[aA]|:)[^&#]*)", 1)
        found = F.coalesce(F.nullif(in_path, F.lit("")), F.nullif(in_query, F.lit("")))
        plain = F.regexp_replace(F.replace(F.replace(F.replace(found, F.lit("%3A"), F.lit(":")), F.lit("%3a"), F.lit(":")), F.lit("%2F"), F.lit("/")), "%2f", "/")
        return F.coalesce(F.regexp_replace(plain, r"^(?i)(https?):/+", "$1://"), url)

    for _ in range(4):
        url = let(url, inner)
    return url


def image_path(url: Column) -> Column:
    """Host and path of a picture, decoded and in lower case, without www., what says how it is served, and query."""

    def key(inner: Column) -> Column:
        path = F.regexp_replace(F.lower(decoded_path(path_of(inner))), r"/max/\d+(?=/)|/size/w\d+(?:h\d+)?(?=/)|/cdn-cgi/image/[^/]+(?=/)", "")

        def told(parts: Column) -> Column:
            return F.array_join(F.filter(parts, lambda p, i: (i == F.size(parts) - 1) | ~p.rlike(TRANSFORMS)), "/")

        segments = F.filter(F.split(path, "/"), lambda p: p != "")
        return F.concat(F.regexp_replace(host_of(inner), r"^www\.", ""), F.lit("/"), let(segments, told))

    return let(inner_image(url), key)


def image_stem(url: Column) -> Column:
    """The file's name in lower case without endings and sizes; null if it says nothing."""
    name = F.regexp_extract(F.lower(decoded_path(path_of(inner_image(url)))), r"([^/]*)/*$", 1)
    return let(F.regexp_replace(F.regexp_replace(name, EXTENSIONS, ""), SIZES, ""), lambda stem: F.when(~stem.isin(*GENERIC), stem))


def largest_in_srcset(srcset: Column) -> Column:
    """The URL of the biggest candidate, by width if any has one, else by density; data: and .jxl candidates don't count; the first of equals."""
    listed = F.regexp_extract_all(srcset, F.lit(r"[^\s,]\S*,(?=\s|$)|[^\s,]\S*(?:[ \t\r\n\f]+[^,\s]+)*"), F.lit(0))

    def candidate(text: Column, at: Column) -> Column:
        url = F.regexp_replace(F.regexp_extract(text, r"^(\S+)", 1), ",+$", "")
        sizes = F.regexp_extract(text, r"^\S+\s*(.*)$", 1)
        width, density = F.regexp_extract(sizes, r"^(\d+)w(?:\s+\d+h)?$", 1), F.regexp_extract(sizes, r"^(\d+(?:\.\d+)?)x$", 1)
        known = (sizes == "") | ((width != "") & (width.try_cast("double") != 0)) | (density != "")
        return F.struct(known.alias("known"), F.when(width != "", width.try_cast("double")).alias("width"), F.coalesce(density.try_cast("double"), F.lit(1.0)).alias("density"), (-at).alias("first"), url.alias("url"))

    shown = F.filter(F.transform(listed, candidate), lambda c: c["known"] & ~c["url"].rlike(r"^(?i)data:|\.jxl(?:$|\?)"))
    wide = F.filter(shown, lambda c: c["width"].isNotNull())
    by_width = F.array_max(F.transform(wide, lambda c: F.struct(c["width"], c["first"], c["url"])))["url"]
    by_density = F.array_max(F.transform(shown, lambda c: F.struct(c["density"], c["first"], c["url"])))["url"]
    return F.coalesce(by_width, by_density)


# Players by host and path, with the page that shows the same and its poster.
PLAYERS = (
    ("video", r"^(?:www\.)?(?:youtube(?:-nocookie)?\.com)/embed/([\w-]{6,})", "https://www.youtube.com/watch?v=", "https://i.ytimg.com/vi/", "/hqdefault.jpg"),
    ("video", r"^player\.vimeo\.com/video/(\d+)", "https://vimeo.com/", "", ""),
    ("audio", r"^open\.spotify\.com/embed/((?:track|episode|show|album|playlist)/\w+)", "https://open.spotify.com/", "", ""),
)
NOISE = r"^(?:www\.)?(?:googletagmanager\.com|disqus\.com|facebook\.com/plugins|platform\.twitter\.com/widgets|giscus\.app|utteranc\.es|doubleclick\.net|addthis\.com|buttondown\.email|substack\.com/embed)"


def embed_kind(src: Column) -> Column:
    """struct<kind, page, poster> of an embedded frame: a known player, noise, or another frame."""
    target = F.concat(F.regexp_replace(host_of(src), "^www[.]", ""), path_of(src))
    none = F.lit(None).cast("string")
    case = F.when(target.rlike(NOISE), F.struct(F.lit("noise").alias("kind"), none.alias("page"), none.alias("poster")))
    for kind, form, page, before, after in PLAYERS:
        found = F.regexp_extract(target, form, 1)
        poster = F.concat(F.lit(before), found, F.lit(after)) if before else none
        case = case.when(found != "", F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(page), found).alias("page"), poster.alias("poster")))
    return case.otherwise(F.struct(F.lit("frame").alias("kind"), src.alias("page"), none.alias("poster")))
