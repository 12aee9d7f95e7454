"""Text functions as Catalyst expressions: normalising, tokens, extensions, hosts, links and buckets."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str, dict[str, str]]:
    """What lower-case text becomes under NFKD without combining marks: characters that turn into one other (the
    marks themselves come last and into none), and those that turn into several with a letter or digit among them.

    Hangul syllables and scripts whose letters stay as they are aren't in it.
    """
    one, marks, several = {}, [], {}
    for code in range(0x80, 0x110000):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or letter != letter.lower():
            continue
        if unicodedata.combining(letter):
            marks.append(letter)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != letter:
            one[letter] = plain
        elif len(plain) > 1 and plain.strip() and any(c.isascii() and c.isalnum() for c in plain):
            several[letter] = plain
    return "".join([*one, *marks]), "".join(one.values()), several


FOLDED, PLAIN, SEVERAL = _folding()


def _ranges(letters: dict[str, str], gap: int = 24) -> str:
    """Pattern of the letters, as ranges that pass over gaps: a few others match too, which only costs time."""
    codes = sorted(map(ord, letters))
    spans = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


_MAY_BE_SEVERAL = _ranges(SEVERAL)


SEVERAL_LETTERS, SEVERAL_TEXTS = "".join(SEVERAL), "\n".join(SEVERAL.values())


def norm(text: Column) -> Column:
    """Lower case, NFKD, without combining marks; stays in the JVM. Hangul syllables are left whole."""
    low = F.lower(text)
    ascii_only = F.octet_length(low) == F.char_length(low)

    def spelled(c: Column) -> Column:
        """What a character is spelled as: the text at its place among those with several letters, or itself."""
        return F.coalesce(F.get(F.split(F.lit(SEVERAL_TEXTS), "\n"), F.position(c, F.lit(SEVERAL_LETTERS)) - 1), c)

    wide = F.array_join(F.transform(F.filter(F.split(low, ""), lambda c: c != ""), spelled), "")
    return F.when(ascii_only, low).otherwise(F.translate(F.when(low.rlike(_MAY_BE_SEVERAL), wide).otherwise(low), FOLDED, PLAIN))


def plain(text: str) -> str:
    """norm() of a literal, outside Spark."""
    return "".join(x for c in text.lower() for x in (c if "가" <= c <= "힣" else unicodedata.normalize("NFKD", c)) if not unicodedata.combining(x))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(norm(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Distinct tokens without single letters, and each run of three digits or more of a token with letters."""
    every = tokens(text)
    kept = F.filter(every, lambda t: (F.char_length(t) > 1) | t.rlike("[0-9]"))
    mixed = F.filter(every, lambda t: t.rlike("[a-z]") & t.rlike("[0-9]{3}"))
    runs = F.flatten(F.transform(mixed, lambda t: F.regexp_extract_all(t, F.lit("[0-9]{3,}"), F.lit(0))))
    return F.array_distinct(F.concat(kept, runs))


def padded(text: Column) -> Column:
    """Tokens with a space on either side, for searching sequences of words."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def ext_of(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(F.instr(base, ".") > 0, F.left(F.lower(F.substring_index(base, ".", -1)), F.lit(8))).otherwise("")


#: The category of an extension; any other extension, and none, is Other.
CATEGORIES = {
    "Video": "mkv mp4 avi mov wmv flv webm m4v mpg mpeg ts m2ts vob iso_video",
    "Audio": "mp3 flac wav aac ogg opus m4a wma ape alac",
    "Images": "jpg jpeg png gif bmp tiff webp svg raw psd",
    "Documents": "pdf epub mobi azw3 djvu doc docx txt rtf odt cbz cbr xls xlsx ppt pptx",
    "Software": "exe msi dmg pkg deb rpm apk appimage iso img jar bin",
    "Archives": "zip rar 7z tar gz bz2 xz zst",
    "Data": "csv json xml sql db parquet dat",
}
OTHER = "Other"
#: Names that a category is asked for by, besides its own, and older names of categories.
ALIASES = {
    "Video": "video videos movie movies pelicula peliculas",
    "Audio": "audio music sound musica sonido",
    "Images": "images image img photo photos imagen imagenes foto fotos",
    "Documents": "doc docs document documents ebook ebooks books documento documentos libros",
    "Software": "software program programs app apps iso programa programas",
    "Archives": "archive archives compressed zip comprimido comprimidos",
    "Data": "data dato datos",
    "Other": "other others otro otros",
}
LEGACY = {"Vídeo": "Video", "Imágenes": "Images", "Documentos": "Documents", "Comprimidos": "Archives", "Datos": "Data", "Otros": "Other"}
#: Extensions with a bit of their own, from the lowest on.
EXT_BITS = "mkv mp4 avi mov wmv m4v ts webm srt sub ass mp3 flac m4a wav ogg aac jpg png gif pdf epub mobi cbz cbr txt nfo iso exe zip rar 7z".split()


def category_of_ext(ext: Column) -> Column:
    out = F.lit(OTHER)
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(*exts.split()), name).otherwise(out)
    return out


def resolve_category(value: Column) -> Column:
    """Category that a name stands for: an alias, its own name in any case, or an older name; null if none."""
    asked = norm(F.btrim(value))
    out = F.lit(None).cast("string")
    for name, aliases in ALIASES.items():
        own = [norm(F.lit(x)) for x in [name, *(old for old, new in LEGACY.items() if new == name)]]
        out = F.when(asked.isin(*aliases.split()) | reduce(lambda a, b: a | b, (asked == x for x in own)), name).otherwise(out)
    return out


def current_category(name: Column) -> Column:
    """name, or what an older name is called now."""
    out = name
    for old, new in LEGACY.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    """Host of a link in lower case; the link itself where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", url).otherwise(host)


def clean(text: Column, limit: int) -> Column:
    """Without control characters and < > |, single spaces, at most limit characters."""
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F<>|]", " "), " +", " ")), 1, limit)


def described(name: Column, paths: Column, files: int) -> Column:
    """What a classifier reads of a document: its name and its first file names, at most 900 characters."""
    listed = F.array_join(F.filter(F.transform(F.slice(paths, 1, max(1, files)), lambda p: clean(p, 120)), lambda p: p != ""), " ; ")
    listed = F.when((F.size(paths) > 0) & F.lit(files > 0), F.concat(F.lit("\nFiles: "), listed)).otherwise("")
    return F.substring(F.concat(F.lit("Torrent name: "), clean(name, 300), listed), 1, 900)


def answered_trackers(entries: Column, own: Column, most: int = 20) -> Column:
    """Tracker urls for a link: those that answered, most seeders first, then all that were asked, then the document's own."""
    asked = F.transform(entries, lambda t, i: F.struct(F.when(t.s.isNotNull() | t.r.isNotNull(), 0).otherwise(1).alias("k"), (-F.coalesce(t.s, F.lit(0))).alias("s"), i.alias("i"), t.u.alias("u")))
    ordered = F.concat(F.filter(F.array_sort(asked), lambda t: t.k == 0), asked)
    urls = F.concat(F.transform(ordered, lambda t: t.u), F.coalesce(own, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(urls, lambda u: F.coalesce(u, F.lit("")).isin("", "?") == F.lit(False))), 1, most)


def brief(detail: Column) -> Column:
    """The last measurement's sources as a list shows them: host instead of url, an error where nothing came back; null without one."""
    source = lambda t: F.struct(host_of(t.u).alias("h"), t.s.alias("s"), t.l.alias("l"), t.r.alias("r"), F.when(F.coalesce(t.e, F.lit("")) != "", t.e).when(t.s.isNotNull(), "").otherwise("no response").alias("e"))
    number = lambda name: F.coalesce(detail[name], F.lit(0)).alias(name)
    shown = F.struct(number("at"), number("cs"), number("cp"), number("dht"), number("md"), F.transform(F.coalesce(detail["tr"], F.array()), source).alias("tr"))
    return F.when(detail.isNotNull(), shown)


def target_of(text: Column) -> Column:
    """(ih, trackers) of a key of 40 hex digits or of a link with one; both null if there is none."""
    found = F.regexp_extract(text, "btih:([0-9a-fA-F]{40})", 1)
    key = F.lower(F.when(found != "", found).otherwise(F.regexp_extract(F.btrim(text), "^([0-9a-fA-F]{40})$", 1)))
    urls = F.transform(F.regexp_extract_all(text, F.lit("[?&]tr=([^&]+)"), F.lit(1)), lambda u: F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))))
    return F.when(key != "", F.struct(key.alias("ih"), urls.alias("trackers")))


ALTERNATIVE = "struct<token:string,logprob:double>"


def alternatives(answer: Column) -> Column:
    """(token, logprob) of the first token of a model's answer (JSON), from whichever of four layouts is there first; null if none is."""
    one = f"array<struct<token:string,logprob:double,top_logprobs:array<{ALTERNATIVE}>>>"
    native = F.from_json(answer, f"logprobs {one}")["logprobs"]
    chat = F.from_json(answer, f"choices array<struct<logprobs:struct<content:{one}>>>")["choices"][0]["logprobs"]["content"]
    older = F.from_json(answer, "choices array<struct<logprobs:struct<top_logprobs:array<map<string,double>>>>>")["choices"][0]["logprobs"]["top_logprobs"]
    each = "array<struct<token:string,tok_str:string,logprob:double,prob:double>>"
    probs = f"completion_probabilities array<struct<top_logprobs:{each},probs:{each}>>"
    own = F.from_json(answer, probs)["completion_probabilities"]
    inner = F.from_json(answer, f"choices array<struct<{probs.replace(' ', ':', 1)}>>")["choices"][0]["completion_probabilities"]
    pair = lambda token, logprob: F.struct(token.cast("string").alias("token"), logprob.cast("double").alias("logprob"))

    def listed(tokens: Column) -> Column:
        top = F.transform(F.get(tokens, F.lit(0))["top_logprobs"], lambda a: pair(F.coalesce(a.token, F.lit("")), a.logprob))
        return F.when(F.size(tokens) > 0, F.when(F.size(top) > 0, top).otherwise(F.array(pair(F.coalesce(F.get(tokens, F.lit(0))["token"], F.lit("")), F.get(tokens, F.lit(0))["logprob"]))))

    def by_chance(tokens: Column) -> Column:
        first = F.get(tokens, F.lit(0))
        some = F.when(F.size(first["top_logprobs"]) > 0, first["top_logprobs"]).otherwise(first["probs"])
        found = F.transform(some, lambda a: pair(F.coalesce(a.token, a.tok_str, F.lit("")), F.coalesce(a.logprob, F.ln(F.greatest(F.coalesce(a.prob, F.lit(0.0)), F.lit(1e-12))))))
        return F.when(F.size(tokens) > 0, F.coalesce(found, F.array().cast(f"array<{ALTERNATIVE}>")))

    mapped = F.when(F.size(older) > 0, F.transform(F.map_entries(F.get(older, F.lit(0))), lambda e: pair(e.key, e.value)))
    return F.coalesce(listed(native), listed(chat), mapped, by_chance(own), by_chance(inner))


def answer_text(answer: Column) -> Column:
    """The text of a model's answer (JSON), from whichever layout is there first."""
    r = F.from_json(answer, "choices array<struct<text:string,message:struct<content:string>>>, response string, content string")
    first = F.get(r["choices"], F.lit(0))
    return F.coalesce(first["text"], r["response"], F.nullif(first["message"]["content"], F.lit("")), r["content"], F.lit(""))


def magnet(key: Column, name: Column, trackers: Column, most: int = 20) -> Column:
    """Link of a key with its name and first distinct trackers, percent-encoded."""

    def quoted(x: Column) -> Column:
        return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))

    urls = F.slice(F.array_distinct(F.filter(trackers, lambda u: ~u.contains("?"))), 1, most)
    return F.concat(F.lit("magnet:?xt=urn:btih:"), key, F.lit("&dn="), F.replace(quoted(name), F.lit("%2F"), F.lit("/")), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("&tr="), quoted(u))), ""))


def bucket(value: Column, edges: list[float], labels: list[str], inclusive: bool = False) -> Column:
    """Label of the first edge above value (inclusive: at or above it); the last label beyond all."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(value <= edge if inclusive else value < edge, label).otherwise(out)
    return out


#: How a classifier's first token names its verdict: by a start, or as one of these cut forms.
VERDICT_STARTS = {"unsafe": "unsafe", "contro": "controversial"}
VERDICT_FORMS = {"unsafe": "un uns unsa unsaf", "controversial": "con cont contr", "safe": "safe sa saf"}


def verdict_of(token: Column) -> Column:
    """unsafe, controversial or safe, by a classifier's first token; null if it is neither."""
    word = F.lower(F.btrim(token))
    out = F.lit(None).cast("string")
    for label, forms in VERDICT_FORMS.items():
        out = F.when(word.isin(*forms.split()), label).otherwise(out)
    for start, label in VERDICT_STARTS.items():
        out = F.when(word.startswith(start), label).otherwise(out)
    return out


def label_of(token: Column, labels: dict[str, str]) -> Column:
    """Class of a classifier's first token by its start; null without one."""
    word = F.lower(F.btrim(token))
    out = F.lit(None).cast("string")
    for start, label in labels.items():
        out = F.when(word.startswith(start), label).otherwise(out)
    return out
