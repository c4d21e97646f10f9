"""Functions of repository paths, as column expressions that stay in generated code.

Globs and ownership patterns are compiled on the driver to one regular expression each, so a list of patterns costs one
rlike per row.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: names that repositories and tools use ---
VENDOR_DIRS = ("node_modules", "bower_components", ".angular", "vendor", "third_party", "third-party", "dist", "build", ".cache")
VENDOR_NAMES = (
    "jquery", "angular-", "angular.", "react", "react-", "lodash", "underscore", "moment", "bootstrap", "ckeditor", "amcharts", "d3.", "d3-", "echarts", "highcharts",
    "sweetalert", "toastr", "handlebars", "ember", "vue", "svelte", "backbone", "knockout",
)
VENDOR_SUFFIXES = (".min.js", ".bundle.js")
INFRA_FILES = ("package-lock.json", "pnpm-lock.yaml", "go.sum", "Jenkinsfile", ".travis.yml", "azure-pipelines.yml", ".gitlab-ci.yml")
INFRA_SUFFIXES = (".lock", ".toml")
INFRA_DIRS = ("migrations/", ".github/", ".circleci/")
JSONC_FILES = ("tsconfig.json", "jsconfig.json", "devcontainer.json")
ASSET_PREFIXES = ("{{ MEDIA_URL }}", "{{ STATIC_URL }}", "{% static '", "url('")
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
COMMANDS = ("**/management/commands/*.py",)
DEFAULT_IGNORES = (
    "**/node_modules/**", "**/venv/**", "**/.venv/**", "**/migrations/**", "**/staticfiles/**", "**/dist/**", "**/build/**", "**/.git/**", "**/.impact_analysis_cache.json",
)


def quoted(words: tuple[str, ...] | list[str]) -> str:
    """Alternatives of a Java regular expression that mean the words themselves."""
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", w) for w in words)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_of(path: Column) -> Column:
    """Folder of a path; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*\.([^.]*)$", 1))


def module_of(path: Column) -> Column:
    """Dotted module of a Python file; a package's own file names the package."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def glob_regex(pattern: str) -> str:
    """Regular expression that finds a glob at the start of any path component; a star also crosses slashes.

    A leading **/ may be absent, a trailing /** also means the folder's own path, and the first inner /**/ may be one slash.
    """
    forms = {pattern}
    if pattern.startswith("**/"):
        forms.add(pattern[3:])
    for p in list(forms):
        if p.endswith("/**"):
            forms.add(p[:-3])
    for p in list(forms):
        at = p.find("/**/", 1)
        if at > 0:
            forms.add(p[:at] + "/" + p[at + 4 :])
    body = "|".join(sorted(_java(p) for p in forms if p))
    return f"(?s)(?:^|/)(?:{body})$"


def _java(glob: str) -> str:
    out = fnmatch.translate(glob)
    return re.sub(r"^\(\?s:(.*)\)(?:\\Z|\\z)$", r"\1", out, flags=re.S).replace("(?>", "(?:")


def matches_glob(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.coalesce(path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)), F.lit(False))


def owner_regex(pattern: str) -> str:
    """Ownership pattern: one without a slash is about file names, others about whole paths."""
    p = pattern.replace("**", "*").strip("/")
    return rf"(?s)^(?:{_java(p)})$" if "/" in p else rf"(?s)(?:^|/)(?:{_java(p).replace('.*', '[^/]*')})$"


def template_name_of(path: Column) -> Column:
    """What follows the last templates/ folder, or null."""
    name = F.regexp_extract(path, r"^(?:.*/)?templates/(.+)$", 1)
    return F.when(name != "", name)


def asset_ref(value: Column, prefixes: tuple[str, ...] = ASSET_PREFIXES) -> Column:
    """Repository path that an asset reference of a template means; null for remote, computed and page references."""
    v = F.trim(value)
    v = F.regexp_replace(v, f"^(?:{quoted(sorted(prefixes, key=len, reverse=True))})", "")
    v = F.trim(F.regexp_replace(F.regexp_replace(v, r"\?.*$", ""), r"^['\"]+|['\"]+$", ""))
    remote = v.rlike(r"(?i)^(?:https?:|//)") | v.contains("{{")
    v = F.regexp_replace(F.regexp_replace(v, r"^(?:\./)+", ""), r"^/+", "")
    return F.when(~remote & (v != "") & ~F.lower(v).endswith(".html"), v)


def is_vendor(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(rf"(?:^|/)(?:{quoted(VENDOR_DIRS)})/") | low.rlike(rf"(?:{quoted(VENDOR_SUFFIXES)})$") | base_name(low).rlike(rf"^(?:{quoted(VENDOR_NAMES)})")


def is_graph_file(path: Column) -> Column:
    return ~base_name(F.lower(path)).rlike(r"\.(?:min|bundle)\.")


def is_test_path(path: Column) -> Column:
    return base_name(path).rlike(r"^tests?_") | path.rlike(r"(?:^|/)tests/") | (path == "tests")


def is_migration_or_infra(path: Column) -> Column:
    return path.rlike(quoted(INFRA_DIRS)) | path.rlike(rf"(?:{quoted(INFRA_SUFFIXES)})$") | base_name(path).isin(*INFRA_FILES) | base_name(path).startswith("Jenkinsfile.")


def is_jsonc(path: Column) -> Column:
    base = base_name(path)
    return base.isin(*JSONC_FILES) | base.endswith(".code-workspace") | base.rlike(r"^[tj]sconfig\..*\.json$") | (path.rlike(r"(?:^|/)\.vscode/") & base.endswith(".json"))


def test_path_of(path: Column) -> Column:
    """Where the test of a Python file would stand; null for test files themselves."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.when(~stem.startswith("test_") & (stem != ""), F.concat(F.lit("tests/test_"), stem, F.lit(".py")))


def suffixes(path: Column) -> Column:
    """Every suffix of a path that starts at a component, for suffix joins by equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def folded(path: Column) -> Column:
    """Path without . and .. components; null if it climbs out of the top."""
    start = F.named_struct(F.lit("parts"), F.array().cast("array<string>"), F.lit("ok"), F.lit(True))

    def step(acc: Column, part: Column) -> Column:
        parts = acc["parts"]
        up = F.named_struct(F.lit("parts"), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit("ok"), acc["ok"] & (F.size(parts) > 0))
        on = F.named_struct(F.lit("parts"), F.concat(parts, F.array(part)), F.lit("ok"), acc["ok"])
        return F.when((part == "") | (part == "."), acc).when(part == "..", up).otherwise(on)

    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["parts"], "/")))


def import_candidates(specifier: Column, importer: Column) -> Column:
    """Paths that a relative script import may mean, in the order in which they are tried."""
    clean = F.regexp_replace(specifier, r"[?#].*$", "")
    base = folded(F.concat(dir_of(importer), F.lit("/"), clean))
    return F.when(clean.startswith("."), F.transform(F.array(*[F.lit(e) for e in SCRIPT_ENDINGS]), lambda e: F.concat(base, e)))
