"""What a file is, told from its path alone: domain, extractor, layer, role, feature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import name_of, parts, suffix_of

# Extensions and names that decide how a file is read.
MARKDOWN = (".md", ".markdown", ".mdx")
CONFIG = (".json", ".yaml", ".yml", ".toml", ".env")
CONFIG_NAMES = (".editorconfig", ".env", ".gitignore", ".npmrc", ".nvmrc", ".prettierignore", ".prettierrc", "dockerfile", "makefile")
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "gemfile.lock", "poetry.lock")
LOGS = (".log",)
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".pdf")
SCRIPT = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
CODE = (".py", *SCRIPT, ".go", ".rs", ".java", ".kt", ".swift", ".rb", ".php", ".c", ".cc", ".cpp", ".h", ".hpp", ".sh")
# Directory names that say nothing about a feature.
GENERIC = (
    "__tests__", "assets", "components", "config", "docs", "helpers", "hooks", "index", "layouts", "models", "modules",
    "navigation", "networking", "pages", "routes", "screens", "services", "shared", "src", "store", "stores", "tests",
    "types", "utilities", "utilityfunctions", "utils", "widgets",
)
FEATURE_EXTENSIONS = (".tsx", ".jsx", ".ts", ".js", ".py", ".md")


def _lower_parts(path: Column) -> Column:
    return F.transform(parts(path), F.lower)


def _under(path: Column, *names: str) -> Column:
    return F.arrays_overlap(_lower_parts(path), F.array(*map(F.lit, names)))


def _ends(name: Column, *ends: str) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | name.endswith(e)
    return out


def _cases(*pairs: tuple[Column, object], default) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def is_lockfile(path: Column) -> Column:
    name = F.lower(name_of(path))
    return name.isin(*LOCKFILES) | name.endswith(".lock")


def content_domain(path: Column) -> Column:
    name, ext = F.lower(name_of(path)), suffix_of(path)
    test = _under(path, "__tests__", "tests") | name.contains(".test.") | name.contains(".spec.")
    return _cases(
        (_under(path, "generated") | is_lockfile(path) | ext.isin(".lock", ".patch") | (name == ".gitkeep"), "generated"),
        (ext.isin(*ASSETS), "asset"),
        (ext.isin(*LOGS), "observability"),
        (ext.isin(*CONFIG) | name.isin(*CONFIG_NAMES) | name.endswith("rc") | name.startswith(".env") | _under(path, ".husky"), "configuration"),
        (ext.isin(*MARKDOWN), "documentation"),
        (ext.isin(*CODE), F.when(test, "test").otherwise("code")),
        default="unknown",
    )


def is_supported(path: Column) -> Column:
    """Whether any extractor has a use for the file."""
    return content_domain(path) != "unknown"


def extractor(path: Column) -> Column:
    domain = content_domain(path)
    return _cases(
        (suffix_of(path).isin(*MARKDOWN), "markdown"),
        (domain == "configuration", "config.lexical"),
        (domain == "observability", "log.lexical"),
        (domain == "asset", "asset.metadata"),
        (domain == "generated", "artifact.metadata"),
        (suffix_of(path) == ".py", "python.ast"),
        default="code.lexical",
    )


def area(path: Column) -> Column:
    return F.when(F.size(parts(path)) > 1, parts(path)[0]).otherwise("root")


def layer(path: Column, domain: Column) -> Column:
    name = F.lower(name_of(path))
    return _cases(
        (domain.isin("documentation", "configuration", "observability"), domain),
        (domain == "asset", "assets"),
        (domain == "test", "tests"),
        (_under(path, "screens", "pages", "routes"), "screens"),
        (_under(path, "components", "widgets"), "components"),
        (_under(path, "hooks") | name.startswith("use"), "hooks"),
        (_under(path, "store", "stores", "redux"), "state"),
        (_under(path, "networking", "api", "apis", "services"), "networking"),
        (_under(path, "navigation", "router"), "navigation"),
        (_under(path, "layouts"), "layouts"),
        (_under(path, "modules", "features"), "features"),
        (_under(path, "models", "types") | name.endswith(".types.ts"), "models"),
        (_under(path, "utils", "utilityfunctions", "helpers"), "utilities"),
        (domain == "unknown", "source"),
        default=domain,
    )


def role(path: Column, domain: Column) -> Column:
    name = F.lower(name_of(path))
    return _cases(
        (domain.isin("documentation", "configuration", "observability", "asset", "generated"), domain),
        ((domain == "test") | name.contains(".test.") | name.contains(".spec."), "test"),
        (_ends(name, ".styles.ts", ".styles.tsx", ".css"), "style"),
        (_ends(name, ".types.ts", ".types.tsx", ".d.ts"), "type"),
        (_ends(name, ".schema.ts", ".schemas.ts"), "schema"),
        (name.startswith("use") | _under(path, "hooks"), "hook"),
        (name.rlike("slice|reducer|selector") | _under(path, "store"), "state"),
        (name.contains("api") | _under(path, "networking", "services"), "api"),
        (_under(path, "navigation") | name.rlike("navigator|router"), "navigation"),
        (_under(path, "screens") | _ends(name, "screen.tsx", "page.tsx"), "screen"),
        (_under(path, "layouts") | name.endswith("layout.tsx"), "layout"),
        (_under(path, "components", "widgets") | _ends(name, ".tsx", ".jsx"), "component"),
        (_under(path, "models"), "model"),
        (_under(path, "utils", "utilityfunctions", "helpers"), "utility"),
        default="source",
    )


def feature(path: Column, domain: Column, markers: tuple[str, ...] = (), generic: tuple[str, ...] = ()) -> Column:
    """The segment after the first marker that has one after it, else a directory that stands for a feature, else null."""
    lower, n = _lower_parts(path), F.size(parts(path))
    dull = sorted({*GENERIC, *(g.lower() for g in generic)})

    def named(segment: Column) -> Column:
        ends = "|".join(e.replace(".", "[.]") for e in FEATURE_EXTENSIONS)
        bare = F.regexp_replace(segment, f"(?i)(?:{ends})$", "")
        return F.when((bare != "") & ~F.lower(bare).isin(*dull), bare)

    pairs = []
    for marker in (*(m.lower() for m in markers), "modules", "features", "screens", "pages", "routes", "components", "widgets"):
        at = F.array_position(lower, marker).cast("int")
        pairs.append(((at > 0) & (at < n), named(F.try_element_at(parts(path), at + 1))))
    second = named(F.try_element_at(parts(path), F.lit(2)))
    return _cases(
        *pairs,
        ((n > 2) & lower[0].isin("src", "app", "lib") & second.isNotNull(), second),
        ((n > 2) & domain.isin("documentation", "configuration"), named(parts(path)[0])),
        (F.lower(name_of(path)).isin("readme.md", "package.json", "pyproject.toml"), "project"),
        default=F.lit(None).cast("string"),
    )


def import_role(target_role: Column, target_layer: Column) -> Column:
    """The relationship that importing a file of this role and layer stands for, or null."""
    return _cases(
        (target_role == "hook", "uses_hook"),
        (target_role == "state", "uses_state"),
        ((target_role == "api") | (target_layer == "networking"), "calls_api"),
        (target_role == "style", "styled_by"),
        (target_role == "type", "typed_by"),
        (target_role == "test", "tested_by"),
        (target_role == "component", "uses_component"),
        default=F.lit(None).cast("string"),
    )
