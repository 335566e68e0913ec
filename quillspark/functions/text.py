"""Text expressions: lines, words, labels, hashes, excerpts. All are plain columns."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, and three notions of a word, as patterns of Java regular expressions.
LINE_END = "\r\n|[\n\u000b\f\r\u001c-\u001e\u0085  ]"
WHITE = "(?U)[^\\s\u001c-\u001f]+"
WORD = "[\\p{L}\\p{N}_]+(?:[-'][\\p{L}\\p{N}_]+)*"
WORD_NO_UNDERSCORE = "[\\p{L}\\p{N}]+(?:['’\\-][\\p{L}\\p{N}]+)*"
WORD_LETTERS = "[\\p{L}\\p{Nl}\\p{No}]+(?:['’\\-][\\p{L}\\p{Nl}\\p{No}]+)*"

#: Fence labels and the name that they are counted under.
FENCE_ALIASES = {
    "(untagged)": "(untagged)",
    "bash": "Shell",
    "sh": "Shell",
    "shell": "Shell",
    "shellscript": "Shell",
    "zsh": "Shell",
    "fish": "Shell",
    "ksh": "Shell",
    "powershell": "PowerShell",
    "ps1": "PowerShell",
    "typescript": "TypeScript",
    "ts": "TypeScript",
    "tsx": "TypeScript",
    "javascript": "JavaScript",
    "js": "JavaScript",
    "jsx": "JavaScript",
    "node": "JavaScript",
    "nodejs": "JavaScript",
    "python": "Python",
    "py": "Python",
    "python3": "Python",
    "json": "JSON",
    "jsonc": "JSON",
    "json5": "JSON",
    "yaml": "YAML",
    "yml": "YAML",
    "text": "Plain text",
    "txt": "Plain text",
    "plaintext": "Plain text",
    "plain": "Plain text",
    "markdown": "Markdown",
    "md": "Markdown",
    "csharp": "C#",
    "cs": "C#",
    "c#": "C#",
    "cpp": "C++",
    "c++": "C++",
    "cxx": "C++",
    "go": "Go",
    "golang": "Go",
    "rust": "Rust",
    "rs": "Rust",
    "sql": "SQL",
    "postgresql": "SQL",
    "postgres": "SQL",
    "mysql": "SQL",
    "sqlite": "SQL",
    "html": "HTML",
    "htm": "HTML",
    "css": "CSS",
    "java": "Java",
    "kotlin": "Kotlin",
    "swift": "Swift",
    "php": "PHP",
    "ruby": "Ruby",
    "lua": "Lua",
    "dart": "Dart",
    "toml": "TOML",
    "xml": "XML",
    "dockerfile": "Dockerfile",
    "mermaid": "Mermaid",
}
UNTAGGED = "(untagged)"


def lines(text: Column) -> Column:
    """Lines without their ends; a closing line end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def word_count(text: Column, pattern: str = WHITE) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{L}"))


def fence_family(label: Column) -> Column:
    """The family of a fence label; labels without one stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in FENCE_ALIASES.items() for x in pair])
    clean = F.lower(F.trim(label))
    return F.coalesce(F.element_at(known, clean), clean)


def tokens(chars: Column, per_token: float = 3.5, uplift: float = 1.0) -> Column:
    """Estimated tokens of so many characters, rounded up."""
    return F.ceil(chars / F.lit(per_token) * F.lit(uplift))


def duration(words: Column, rate: float) -> Column:
    """Reading time as s, min or h."""
    m = words / F.lit(float(rate))
    return F.when(m < 1, F.format_string("%.0f s", F.rint(m * 60))).when(m >= 60, F.format_string("%.1f h", m / 60)).otherwise(F.format_string("%.1f min", m))


def fence_fold(content: Column) -> Column:
    """struct(open, blocks, outside, headings) of a text's lines by one fold: backtick or tilde fences with up to three blanks before, ATX headings outside."""
    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("size"), F.lit(0).alias("blocks"), F.lit(0).alias("outside"), F.lit(0).alias("headings"))

    def step(s: Column, line: Column) -> Column:
        run = F.regexp_extract(line, "(?d)^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1)
        closing = F.regexp_extract(line, "(?d)^ {0,3}(`{3,}|~{3,})[ \\t]*$", 1)
        inside = s["mark"] != ""
        closes = inside & (F.substring(closing, 1, 1) == s["mark"]) & (F.length(closing) >= s["size"])
        opens = ~inside & (run != "")
        plain = ~inside & ~opens
        head = plain & line.rlike("(?d)^ {0,3}#{1,6}([ \\t]|$)")
        return F.struct(
            F.when(closes, "").when(opens, F.substring(run, 1, 1)).otherwise(s["mark"]).alias("mark"),
            F.when(closes, 0).when(opens, F.length(run)).otherwise(s["size"]).alias("size"),
            (s["blocks"] + opens.cast("int")).alias("blocks"),
            (s["outside"] + plain.cast("int")).alias("outside"),
            (s["headings"] + head.cast("int")).alias("headings"),
        )

    return F.aggregate(lines(content), start, step, lambda s: F.struct((s["mark"] != "").alias("open"), s["blocks"].alias("blocks"), s["outside"].alias("outside"), s["headings"].alias("headings")))


def half_even(x: Column, digits: int = 6) -> Column:
    return F.bround(x, digits)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def identity(content_hash: Column, file_id: Column) -> Column:
    """The content hash, or an identity of the file's own where it has none."""
    return F.coalesce(content_hash, F.format_string("id:%020d", file_id))


def named_identity(content_hash: Column, file_id: Column) -> Column:
    return F.when(content_hash.isNull() | (content_hash == ""), F.concat(F.lit("file-id:"), file_id.cast("string"))).otherwise(content_hash)


def escaped_excerpt(text: Column, limit: int = 600) -> Column:
    cut = F.replace(F.replace(F.substring(text, 1, limit), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("…"))).otherwise(cut)


def compact_excerpt(text: Column, limit: int = 500) -> Column:
    one = F.trim(F.regexp_replace(text, "(?U)[\\s\u001c-\u001f]+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…")))


def truncated(text: Column, limit: int) -> Column:
    """At most so many characters, cut at the last space if there is one."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.trim(F.regexp_replace(cut, " [^ ]*$", "")))


@cache
def foldings() -> dict[str, str]:
    """Characters whose full case folding isn't their lower case, or whose lower case depends on their neighbours."""
    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c.lower() or c in "\u03a3\u03c2\u0130"}


def casefold(text: Column) -> Column:
    """Full case folding: lower case, but character by character where one of some 300 special characters occurs."""
    known = F.create_map(*[F.lit(x) for pair in foldings().items() for x in pair])
    special = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in foldings()) + "]"
    by_character = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.element_at(known, x), F.lower(x))), "")
    return F.when(text.rlike(special), by_character).otherwise(F.lower(text))


def letters_only(text: Column) -> Column:
    """Lower-cased words of letters, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD_LETTERS), F.lit(0)), " ")


def language_code(code: Column) -> Column:
    """A detector's label as a plain code: without its prefix, nb as no."""
    bare = F.replace(F.lower(F.replace(code, F.lit("__label__"), F.lit(""))), F.lit("_"), F.lit("-"))
    return F.when(bare == "nb", "no").otherwise(bare)


#: Script blocks as code point ranges, in the order in which they are tried, and the languages of a script.
SCRIPTS = {
    "Japanese kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
    "Cyrillic": [(0x0400, 0x052F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)],
    "Hebrew": [(0x0590, 0x05FF)],
    "Greek": [(0x0370, 0x03FF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "Armenian": [(0x0530, 0x058F)],
}
SCRIPT_LANGUAGES = {
    "Japanese kana": ["ja"],
    "Hangul": ["ko"],
    "Han": ["zh", "ja"],
    "Cyrillic": ["be", "bg", "kk", "ky", "mk", "mn", "ru", "sr", "tg", "uk"],
    "Arabic": ["ar", "fa", "ps", "sd", "ug", "ur"],
    "Hebrew": ["he", "yi"],
    "Greek": ["el"],
    "Devanagari": ["hi", "mr", "ne", "sa"],
    "Bengali": ["as", "bn"],
    "Gurmukhi": ["pa"],
    "Gujarati": ["gu"],
    "Tamil": ["ta"],
    "Telugu": ["te"],
    "Kannada": ["kn"],
    "Malayalam": ["ml"],
    "Thai": ["th"],
    "Georgian": ["ka"],
    "Armenian": ["hy"],
}


def _script_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def dominant_script(text: Column) -> Column:
    """The most frequent listed script if it has 10 characters and two fifths of the letters; else Latin/other, mixed or none."""
    rest = _script_class([x for r in SCRIPTS.values() for x in r]).replace("[", "[^", 1) + "+"
    # Most texts have no listed script: one pass takes out all other characters, and only what is left is counted by script. What a lambda takes is made once.
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    best = lambda x: F.array_max(F.array(*[F.struct(F.regexp_count(x, F.lit(_script_class(r))).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("script")) for k, (name, r) in enumerate(SCRIPTS.items())]))
    judged = lambda s: once(best(s["listed"]), lambda b: F.when((b["n"] < 10) | (b["n"] / s["letters"] < 0.4), "mixed").otherwise(b["script"]))
    whole = F.struct(letters(text).alias("letters"), F.regexp_replace(text, rest, "").alias("listed"))
    return once(whole, lambda s: F.when(s["letters"] == 0, "none").when(s["listed"] == "", "Latin/other").otherwise(judged(s)))


def script_fits(language: Column, script: Column) -> Column:
    known = F.create_map(*[x for name, codes in SCRIPT_LANGUAGES.items() for x in (F.lit(name), F.array(*map(F.lit, codes)))])
    return F.coalesce(F.array_contains(F.element_at(known, script), language), F.lit(True))
