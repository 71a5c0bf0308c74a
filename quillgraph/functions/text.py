"""Text functions: licence similarity, masking of secrets, spans, roles of paths, package URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key words whose values are masked.
SECRET_KEYS = "password|passwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential"
#: Roles of path segments, first match wins.
ROLES = (("fixture", "tests?|testdata|fixtures?|spec"), ("vendored", "vendor|third[_-]party"), ("example", "examples?|samples?|demos?"), ("docs", "docs?|documentation"))
INSTALL_DIRS = "node_modules|site-packages|dist-packages"


def license_tokens(text: Column) -> Column:
    """Lower-case words without the lines that begin with "copyright"."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?im)^[ \t]*copyright\b.*$", " ")), F.lit(r"[a-z0-9]+"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def dice(a: Column, b: Column) -> Column:
    """2 |A & B| / (|A| + |B|) of two sets held as arrays."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def masked(text: Column) -> Column:
    """Values after a secret's key (``=`` or ``:``) become ***; the key stays."""
    return F.regexp_replace(text, rf"(?i)\b([\w-]*(?:{SECRET_KEYS})[\w-]*\s*[=:]\s*)[^\s,;]+", "$1***")


def line_of(text: Column, token: Column) -> Column:
    """1-based line of a token's first occurrence; null without one."""
    at = F.instr(text, token)
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at - 1), "\n")))


def snippet(text: Column, token: Column, context: int = 0) -> Column:
    """The token's line with ``context`` lines on either side."""
    line = line_of(text, token)
    first = F.greatest(line - context, F.lit(1))
    return F.when(line.isNotNull(), F.array_join(F.slice(F.split(text, "\n"), first, line - first + 1 + context), "\n"))


def path_role(path: Column) -> Column:
    """fixture, vendored, example or docs by a folder of the path; null inside install folders."""
    out = F.lit(None).cast("string")
    for name, words in reversed(ROLES):
        out = F.when(path.rlike(rf"(?i)(^|/)({words})/"), name).otherwise(out)
    return F.when(path.rlike(rf"(^|/)({INSTALL_DIRS})/"), None).otherwise(out)


def purl(kind: Column, name: Column, version: Column, namespace: Column | None = None) -> Column:
    """pkg:type/namespace/name@version with percent-encoded parts."""
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":"))
    parts = [F.concat(F.lit("pkg:"), F.lower(kind)), *([encode(namespace)] if namespace is not None else []), encode(name)]
    return F.concat(F.concat_ws("/", *parts), F.coalesce(F.concat(F.lit("@"), encode(version)), F.lit("")))


def purl_part(column: Column, part: str) -> Column:
    patterns = {"type": r"^pkg:([^/]+)/", "namespace": r"^pkg:[^/]+/(.+)/[^/@]+(?:@|\?|$)", "name": r"^pkg:(?:[^/]+/)+([^/@?]+)", "version": r"@([^?#]+)"}
    return F.nullif(F.regexp_extract(column, patterns[part], 1), F.lit(""))


def soname_token(path: Column) -> Column:
    """libssl.so.3 -> ssl."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(so|dylib|dll)(\..*)?$", ""), "^lib", "")


def created_by(raw: Column) -> Column:
    """A layer's build step without the shell wrapper and with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"^/bin/sh -c (#\(nop\)\s*)?", ""), r"\s+", " "))


def image_reference(raw: Column) -> Column:
    """struct(registry, repository, tag, digest, pinned) of an image reference."""
    get = lambda p, k: F.nullif(F.regexp_extract(raw, p, k), F.lit(""))
    pattern = r"^(?:((?:[^/]*[.:][^/]*|localhost))/)?([^:@]+)(?::([^@]+))?(?:@(.+))?$"
    return F.struct(F.coalesce(get(pattern, 1), F.lit("docker.io")).alias("registry"), get(pattern, 2).alias("repository"), get(pattern, 3).alias("tag"), get(pattern, 4).alias("digest"), get(pattern, 4).isNotNull().alias("pinned"))


def sri(value: Column) -> Column:
    """struct(algorithm, hex) of a subresource-integrity string."""
    return F.struct(F.substring_index(value, "-", 1).alias("algorithm"), F.lower(F.hex(F.try_to_binary(F.substring_index(value, "-", -1), F.lit("base64")))).alias("hex"))


#: Where package stores lie.
STORES = r"(^|/)(node_modules|\.pnpm|site-packages|dist-packages|\.venv)/|(^|/)vendor/(bundle|composer)/|/\.m2/repository/|/\.cargo/registry/|/\.cache/go/|/pkg/mod/|/gems/"


def in_store(path: Column) -> Column:
    """Whether a path lies in a package store."""
    return path.rlike(STORES)


def physical_path(parents: Column) -> Column:
    """One path from an array of the paths of archives within archives, outermost first."""
    return F.array_join(parents, "!")


def platform_parts(text: Column) -> Column:
    """(os, arch, variant) of os/arch[/variant], linux/amd64 where there is none; null where it has another form."""
    parts = F.split(F.coalesce(text, F.lit("linux/amd64")), "/", 3)
    at = lambda k: F.nullif(F.try_element_at(parts, F.lit(k)), F.lit(""))
    return F.when(at(1).isNotNull() & at(2).isNotNull(), F.struct(at(1).alias("os"), at(2).alias("arch"), at(3).alias("variant")))


#: Package types whose names and namespaces don't tell letter case.
CASELESS = ("bitbucket", "github", "gitlab", "pypi")


def canonical_purl(raw: Column) -> Column:
    """The one spelling of a package URL: lower-case type, percent-encoded parts, qualifiers by key without empty ones; null for what is none."""
    pattern = r"^(?i:pkg):/*([A-Za-z][A-Za-z0-9.+-]*)/+([^?#]*?)(?:@([^?#@/]*))?(?:\?([^#]*))?(?:#(.*))?$"
    at = lambda k: F.regexp_extract(raw, pattern, k)
    kind = F.lower(at(1))
    plain = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    encode = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":")), F.lit("*"), F.lit("%2A"))
    cased = lambda c: F.when(kind.isin(*CASELESS), F.lower(c)).otherwise(c)
    parts = F.filter(F.split(at(2), "/"), lambda x: x != "")
    path = F.transform(parts, lambda x: cased(plain(x)))
    last = F.try_element_at(path, F.lit(-1))
    name = F.when(kind == "pypi", F.replace(last, F.lit("_"), F.lit("-"))).otherwise(last)
    place = F.concat(F.transform(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), encode), F.array(encode(name)))
    pairs = F.transform(F.filter(F.split(at(4), "&"), lambda q: q.rlike(r"^[^=]+=.")), lambda q: F.concat(F.lower(F.substring_index(q, "=", 1)), F.lit("="), encode(plain(F.substring_index(q, "=", -1)))))
    tail = F.concat(F.when(at(3) != "", F.concat(F.lit("@"), encode(plain(at(3))))).otherwise(""), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise(""), F.when(at(5) != "", F.concat(F.lit("#"), at(5))).otherwise(""))
    return F.when(raw.rlike(pattern) & (F.size(parts) > 0), F.concat(F.lit("pkg:"), kind, F.lit("/"), F.array_join(place, "/"), tail))
