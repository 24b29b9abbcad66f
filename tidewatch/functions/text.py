"""Text functions of the repository model: paths that may be read, tokens, and explanation text without secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .columns import pick

# Suffixes that may be read.
SUFFIXES = ["c", "cc", "cpp", "cs", "css", "go", "h", "hpp", "html", "java", "js", "json", "jsx", "kt", "md", "php", "py", "rb", "rs", "sh", "sql", "toml", "ts", "tsx", "txt", "yaml", "yml"]
# Generated and secret directories, secret file names, generated suffixes.
GENERATED = [".next", "build", "coverage", "dist", "node_modules", "vendor"]
SECRET_DIRS, SECRET_NAMES = [".aws", ".ssh", "credentials", "secrets"], ["id_ed25519", "id_rsa", ".env"]
# Language of a suffix.
LANGUAGES = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "css": "css", "go": "go", "h": "c", "hpp": "cpp", "html": "html", "java": "java", "js": "javascript", "json": "json", "jsx": "javascript",
    "kt": "kotlin", "md": "markdown", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "sh": "shell", "sql": "sql", "toml": "toml", "ts": "typescript", "tsx": "typescript", "yaml": "yaml", "yml": "yaml",
}
# File names that some file systems reserve, whatever their suffix.
RESERVED = r"(^|/)(?i:con|prn|aux|nul|clock\$|com[1-9]|lpt[1-9])(\.[^/]*)?[. ]*(/|$)"
MAX_PATH = 512


def safe_path(path):
    """Whether a repository path may be read: relative, plain, neither generated nor secret, of an allowed suffix."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    plain = (F.length(path) <= MAX_PATH) & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\0")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    generated = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(GENERATED))
    secret = F.exists(parts, lambda p: p.isin(SECRET_DIRS)) | name.isin(SECRET_NAMES) | name.startswith(".env.")
    return plain & ~generated & ~secret & ~name.rlike(r"\.(map|min\.css|min\.js|lock)$") & F.regexp_extract(name, r"\.([^.]*)$", 1).isin(SUFFIXES)


def patch_path(path):
    """Whether a path may be written: relative, plain on every file system, at most MAX_PATH characters and bytes; of any name and suffix."""
    parts = F.split(path, "/")
    short = (F.length(path) <= MAX_PATH) & (F.octet_length(path) <= MAX_PATH)
    whole = ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~path.rlike(r"[\x00-\x1f:\\]") & ~path.rlike(r"[. ](/|$)")
    return short & whole & ~path.rlike(RESERVED)


def language(path):
    """The language of a path's suffix; a name that begins with its only dot has none."""
    return pick(F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)), LANGUAGES)


def tokens(text):
    """Words of letters, digits, _ and - (2 to 64 long), lower-cased, and their parts of 2 or more."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9_-]{1,63})"), F.lit(1)), F.lower)
    return F.array_distinct(F.concat(whole, F.filter(F.flatten(F.transform(whole, lambda w: F.split(w, "[_-]+"))), lambda p: F.length(p) >= 2)))


# the classes of Python's regular expressions over text, which Java's \s and \b are not
_S = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_SECRET = r"(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----"
_RULES = [
    (r"(?s)```.*?```", "[source code omitted]"),
    (_SECRET, "[secret omitted]"),
    (rf"{_B}(?:gh[pousr]_[A-Za-z0-9_]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}}){_E}", "[GitHub token omitted]"),
    (rf"(?iu){_B}Bearer{_S}+[A-Za-z0-9._~+/-]{{8,}}", "Bearer [token omitted]"),
    (rf"(?iu){_B}(?:api[_-]?key|token|secret|password){_S}*[:=]{_S}*['\"]?[^{_S[1:-1]},;\])'\"]{{6,}}", "[secret omitted]"),
]
_LINE = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
_SOURCE = rf"^{_S}*(?:async{_S}+def{_E}|(?:def|class|function|import|from|return|const|let|var|package|#include){_E}|[A-Za-z_][A-Za-z0-9_.]*{_S}*={_S}*[^=])"


def sanitize_text(text, maximum=None):
    """Explanation text without code blocks, secrets and lines like source code, on one line; cut to maximum characters if given."""
    for pattern, instead in _RULES:
        if pattern == _SECRET:
            # every opening without an end would look for one up to the end of the text: only what comes before the last end is searched
            to = F.length(text) - F.locate("DNE-----", F.reverse(text)) + 1
            closing = F.instr(F.substring(text, to + 1, F.length(text)), "-----")
            head = F.when(F.contains(text, F.lit("-----END ")), F.substring(text, F.lit(1), to + F.when(closing > 0, closing + 4).otherwise(0))).otherwise("")
            text = F.concat(F.regexp_replace(head, pattern, instead), F.substring(text, F.length(head) + 1, F.length(text)))
        else:
            text = F.regexp_replace(text, pattern, instead)
    lines = F.transform(F.split(text, _LINE, -1), lambda x: F.when(x.rlike(_SOURCE), "[source code omitted]").otherwise(x))
    clean = F.trim(F.regexp_replace(F.array_join(lines, " "), f"{_S}+", " "))
    clean = F.when(clean == "", "[details omitted]").otherwise(clean)
    return clean if maximum is None else F.substring(clean, 1, maximum)
