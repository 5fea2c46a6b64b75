"""Column functions over identifiers and literals: normalising, splitting, masking, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never digest tokens.
STOP = (
    "if else while for return switch case break continue goto sizeof do void int char long short float double unsigned signed "
    "bool true false null nullptr uint ulong ushort byte undefined undefined1 undefined2 undefined4 undefined8 code param local "
    "stack var unaff extraout in out ram fun sub ptr concat sext zext memcpy memset strlen strcmp strcpy strncpy strncmp malloc "
    "calloc realloc free printf fprintf sprintf the and for with not this that from func file line error warning failed invalid "
    "cannot could unable halt baddata warning"
).split()


def normalize_name(name: Column) -> Column:
    """Without spaces, outer underscores and dots; lower case."""
    return F.lower(F.btrim(F.replace(name, F.lit(" "), F.lit("")), F.lit("_.")))


def _camel(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")


def split_name(name: Column) -> Column:
    """Sub-tokens: camel humps, underscores, dots and hyphens part them; digits do not."""
    parts = F.split(_camel(F.btrim(F.replace(name, F.lit(" "), F.lit("")), F.lit("_."))), "[_.\\-]+")
    return F.filter(F.transform(parts, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def votes_subtokens(name: Column) -> Column:
    """Sub-tokens with the underscores kept as tokens; only a small letter before a capital is a hump."""
    marked = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    return F.filter(F.transform(F.split(F.replace(marked, F.lit("_"), F.lit("\u0001_\u0001")), "\u0001"), F.lower), lambda t: t != "")


def digest_tokens(text: Column) -> Column:
    """Evidence tokens: three to 24 characters, not a number, not a stop word."""
    parts = F.split(F.lower(_camel(text)), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 2) & (F.length(t) < 25) & ~t.rlike("^[0-9]+$") & ~t.isin(STOP))


def diagnostic_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(_camel(name)), "[^a-z0-9]+"), lambda t: t != "")


def string_tokens_v1(text: Column, most: int = 5) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "%[-+0 #]*[0-9]*\\.?[0-9]*[hlLzjt]*[diouxXeEfFgGaAcspn%]", ""), "[^a-zA-Z0-9_ ]", " ")
    return F.slice(F.filter(F.split(F.lower(plain), " +"), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$")), 1, most)


def string_tokens_v2(text: Column, most: int = 8) -> Column:
    return F.slice(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), F.lower), lambda t: F.length(t) >= 2), 1, most)


def canonical_name(name: Column) -> Column:
    """Without argument list and template arguments; the last two parts of a qualified name."""
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "\\(.*\\)$", ""), "<[^<>]*>", ""), "<[^<>]*>", "")
    parts = F.filter(F.slice(F.split(F.concat(F.lit("::"), n), "::"), -2, 2), lambda p: p != "")
    return F.array_join(parts, "_")


def mask_first(text: Column, name: Column, mask: str) -> Column:
    at = F.instr(text, name)
    return F.when((at > 0) & (F.length(name) > 0), F.overlay(text, F.lit(mask), at, F.length(name))).otherwise(text)


def mask_all(text: Column, name: Column, mask: str) -> Column:
    return F.when(F.length(name) > 0, F.replace(text, name, F.lit(mask))).otherwise(text)


def _whole(name: Column) -> Column:
    return F.concat(F.lit("\\b"), F.regexp_replace(name, "([^A-Za-z0-9_])", "\\\\$1"), F.lit("\\b"))


def mask_whole_words(text: Column, name: Column, mask: str) -> Column:
    return F.when(F.length(name) > 0, F.regexp_replace(text, _whole(name), F.lit(mask))).otherwise(text)


def body_hash(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, "|").cast("binary"))


def safe_name(name: Column) -> Column:
    """A file name: other characters become underscores; long names end in a hash."""
    s = F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")
    return F.when(F.length(s) > 80, F.concat(F.substring(s, 1, 70), F.lit("_"), F.substring(F.md5(name.cast("binary")), 1, 8))).otherwise(s)


def package_of(binary: Column) -> Column:
    return F.element_at(F.split(binary, "_"), 1)


def program_of(binary: Column) -> Column:
    return F.regexp_replace(binary, "_O[0-3]$", "")


def opt_of(binary: Column) -> Column:
    got = F.regexp_extract(binary, "_(O[0-3])$", 1)
    return F.when(got == "", "default").otherwise(got)


# Patterns of names that carry no meaning, binding ranks, and package groups.
DISCARD = (
    "^_start$", "^__libc_", "^_init$", "^_fini$", "^__do_global_", "^frame_dummy$", "^register_tm_clones$", "^deregister_tm_clones$", r"^__x86\.", r"^\.",
    "^_GLOBAL_", "^__cxa_", "^__stack_chk", "^__assert_fail$", "^__ctype_", "^__errno_", "^__overflow$", r"^\.plt", r"^\.init", r"^\.fini",
)
SKIP = (
    r"^\.plt$", r"^\.init$", r"^\.fini$", r"^\.text$", r"^\._", "^_start$", "^_init$", "^_fini$", "^register_tm_clones$", "^deregister_tm_clones$",
    "^frame_dummy$", "^__do_global_", "^__libc_csu_", "^_dl_",
)
BINDING = {"GLOBAL": 0, "WEAK": 1, "LOCAL": 2}
CATEGORIES = {
    "GNU Core Utils": "coreutils coreutils2 findutils findutils2 sed sed2 tar tar2 gzip gzip2 patch patch2 grep grep2 gawk which which2 diffutils",
    "Text Processing": "m4 make less bison flex enscript texinfo spell indent wdiff gawk2",
    "Dev Tools": "binutils bash bc",
    "Networking": "wget inetutils",
    "Crypto/Security": "openssl nettle",
    "Compression": "lz4 zlib xz",
    "Data/Libraries": "sqlite lua jq",
    "System/Monitoring": "strace screen nano htop time cpio units units2",
    "Embedded": "busybox",
    "Typography": "groff",
    "Other GNU": "hello direvent cppi csplit2 combinatorics rush gcal sharutils gnuchess gperf datamash ed",
}


def discarded(name: Column) -> Column:
    """True for missing, one-character and start-up names."""
    return F.coalesce(F.length(name) < 2, F.lit(True)) | name.rlike("|".join(DISCARD))


def skipped(name: Column) -> Column:
    """True for missing and section names; functions named by address are never skipped."""
    return F.coalesce(F.length(name) < 1, F.lit(True)) | (~name.rlike("^sub_[0-9a-fA-F]+(sub_|$)") & name.rlike("|".join(SKIP)))


def canonical_alias(aliases: Column) -> Column:
    """Best of an array of struct(name, binding): by binding, no leading underscore, length, then text."""
    rank = F.create_map(*[F.lit(x) for kv in BINDING.items() for x in kv])
    key = lambda a: F.struct(F.coalesce(F.try_element_at(rank, a["binding"]), F.lit(3)).alias("r"), a["name"].startswith("_").alias("u"), F.length(a["name"]).alias("n"), a["name"].alias("name"))
    return F.array_min(F.transform(aliases, key))["name"]


def normal_address(address: Column) -> Column:
    """0x and the digits without leading zeros; zero is 0x0."""
    digits = F.ltrim(F.regexp_replace(address, "^0x", ""), F.lit("0"))
    return F.concat(F.lit("0x"), F.when(digits == "", "0").otherwise(digits))


def project_of(version: Column) -> Column:
    """A project name without its version."""
    return F.regexp_replace(F.replace(F.lower(version), F.lit("openssl-openssl"), F.lit("openssl")), r"[-_]\d[\d.]*[a-z]?$", "")


def has_prefix(name: Column, packages: list[str], sep: str = "_") -> Column:
    """True when name starts with one of the packages and the separator."""
    return F.substring_index(name, sep, 1).isin(packages) & name.contains(sep) if all(sep not in p for p in packages) else name.rlike("^(" + "|".join(p.replace(".", "\\.") for p in packages) + ")" + sep)


def package_category(package: Column) -> Column:
    pairs = [F.lit(x) for cat, names in CATEGORIES.items() for n in names.split() for x in (n, cat)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), package), F.lit("Other"))


def bucket(value: Column, edges: list, labels: list[str]) -> Column:
    """Label of the first edge that value does not exceed; the last label beyond all edges."""
    out = F.when(value <= edges[0], labels[0])
    for e, x in zip(edges[1:], labels[1:], strict=False):
        out = out.when(value <= e, x)
    return out.otherwise(labels[-1])


def call_bucket(n: Column) -> Column:
    return F.when(n == 0, "0 ext").when(n <= 3, "1-3 ext").otherwise("4+ ext")


def block_bucket(n: Column) -> Column:
    """0 to 6: at most 1, 2, 4, 8, 16, 32 blocks, and more."""
    return bucket(n, [1, 2, 4, 8, 16, 32], list("0123456")).cast("int")


def mask_first_word(text: Column, name: Column, mask: str) -> Column:
    """The first whole-word occurrence only."""
    at = F.regexp_instr(text, _whole(name))
    return F.when((F.length(name) > 0) & (at > 0), F.overlay(text, F.lit(mask), at, F.length(name))).otherwise(text)


def answer_first_word(text: Column) -> Column:
    """First word of a generated answer without end marks and the leading phrase; empty if none."""
    plain = F.btrim(F.replace(text, F.lit("</s>"), F.lit("")), F.lit(" \t\n\r"))
    rest = F.btrim(F.regexp_replace(plain, r"^The predicted function name is\s*", ""), F.lit(" \t\n\r"))
    return F.coalesce(F.regexp_extract(rest, r"^(\S+)", 1), F.lit(""))


def answer_identifier(text: Column) -> Column:
    """First identifier of a generated answer, marks around it stripped; empty if none, and for null."""
    plain = F.replace(F.replace(text, F.lit("The predicted function name is"), F.lit(" ")), F.lit("</s>"), F.lit(" "))
    return F.coalesce(F.regexp_extract(F.btrim(F.btrim(plain, F.lit(" \t\n\r")), F.lit("`\"' .")), "[A-Za-z_][A-Za-z0-9_]*", 0), F.lit(""))


def answer_phrase(text: Column) -> Column:
    """What follows the leading phrase of a generated answer up to an end mark or a closing full stop, or else the whole answer; outer space and closing full stops go."""
    plain = F.btrim(text, F.lit(" \t\n\r\f\u000b"))
    said = r"^The predicted function name is (.*?)(?:</s>|\.\s*$|\s*$)"
    return F.rtrim(F.btrim(F.when(plain.rlike(said), F.regexp_extract(plain, said, 1)).otherwise(plain), F.lit(" \t\n\r\f\u000b")), F.lit("."))


def demangled(name: Column, table: Column) -> Column:
    """Canonical name after a look-up in a map of mangled names."""
    return canonical_name(F.coalesce(F.try_element_at(table, name), name))
