"""Scalar operators as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metergrid.schema import TOKENS


def token_total() -> Column:
    """Input, output, cache reads and cache writes; reasoning is inside output, one-hour writes inside writes."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in TOKENS])


def project_key() -> Column:
    return F.coalesce("repository", "project")


def device() -> Column:
    return F.coalesce("device_id", F.lit("local"))


def session_key() -> Column:
    """Identity of a session; null where the event has none."""
    return F.when(F.col("session_id") != "", F.concat_ws(":", device(), "harness", "session_id"))


def request_count() -> Column:
    """Unreported requests are one; a reported 0 stays 0."""
    return F.coalesce("requests", F.lit(1))


# The provider of a namespace, and of a model name's first letters.
NAMESPACES = {
    "openai": "openai", "anthropic": "anthropic", "xai": "xai", "x-ai": "xai", "google": "google", "gemini": "google", "google_genai": "google", "vertex_ai": "google", "vertex-ai": "google",
    "deepseek": "deepseek", "qwen": "alibaba", "alibaba": "alibaba", "dashscope": "alibaba", "mistral": "mistral", "mistralai": "mistral", "meta": "meta", "meta-llama": "meta",
    "moonshot": "moonshot", "moonshotai": "moonshot", "zai": "zai", "z-ai": "zai", "zhipu": "zai", "cohere": "cohere", "amazon": "amazon", "aws": "amazon", "bedrock": "amazon",
    "bedrock_converse": "amazon", "bedrock_mantle": "amazon", "azure": "azure", "azure_ai": "azure", "openrouter": "openrouter", "together": "together", "together_ai": "together",
    "groq": "groq", "perplexity": "perplexity", "nvidia": "nvidia", "huggingface": "huggingface", "fireworks": "fireworks", "fireworks_ai": "fireworks",
}
FAMILIES = [
    ("openai", ("gpt-", "chatgpt-", "o1-", "o3-", "o4-", "codex-mini-")), ("anthropic", ("claude-",)), ("google", ("gemini-", "gemma-")), ("xai", ("grok-",)), ("deepseek", ("deepseek-",)),
    ("alibaba", ("qwen",)), ("mistral", ("mistral-", "mixtral-", "codestral-", "magistral-", "ministral-", "devstral-")), ("meta", ("llama-", "llama2-", "llama3-", "llama4-", "muse-")),
    ("moonshot", ("kimi-", "moonshot-")), ("zai", ("glm-",)), ("cohere", ("command-r", "command-a")), ("amazon", ("amazon.nova-",)),
]


_SPACES: dict[str, list[str]] = {}
for _space, _who in NAMESPACES.items():
    _SPACES.setdefault(_who, []).append(_space)
#: The rule as text, which is parsed at once.
_PROVIDER = (
    "CASE WHEN contains({0}, '/') THEN CASE " + " ".join(f"WHEN substring_index({{0}}, '/', 1) IN ({', '.join(map(repr, s))}) THEN '{w}'" for w, s in _SPACES.items()) + " ELSE 'unknown' END WHEN {0} IN ('o1', 'o3', 'o4') THEN 'openai' "
    + " ".join(f"WHEN {' OR '.join(f'startswith({{0}}, {s!r})' for s in starts)} THEN '{w}'" for w, starts in FAMILIES) + " ELSE 'unknown' END"
)


def provider(column: str) -> Column:
    """The provider of the model that the column names."""
    return F.expr(_PROVIDER.format(f"lower(trim({column}))"))


def round_cost(cost: Column) -> Column:
    """Six decimals from 0.001 on, six significant digits below; 0 for what is not finite. Rounded as floor(x + 1/2) of
    the scaled double. Sums come rounded to nine places, so that the order of adding decides no half."""
    size = F.abs(cost)
    scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(size)))
    half_up = lambda x: F.floor(x + 0.5).cast("double")
    return F.when(cost.isNull() | F.isnan(cost) | (size == float("inf")) | (cost == 0), F.lit(0.0)).when(size >= 0.001, half_up(cost * 1e6) / 1e6).otherwise(half_up(cost * scale) / scale)


def project_parts(key: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, "^local:", ""), "^https?://", ""), r"\.git$", "")
    return F.filter(F.split(plain, r"[\\/]"), lambda x: x != "")


def project_label(key: Column) -> Column:
    """The last two path parts, or the key itself where there are none."""
    parts = project_parts(key)
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/"), F.lit("")), key)


def canonical_repository(remote: Column) -> Column:
    """host/path of an scp, ssh, https or git remote without credentials and .git; null if it is none of them."""
    text = F.trim(remote)
    short = F.when(~text.contains("://"), F.regexp_extract(text, r"^(?:[^@/]+@)?([^/:]+):[^/].*$", 1)).otherwise(F.lit(""))
    url = r"^(?i:https?|ssh|git)://(?:[^/@?#]*@)?([^/:@?#]+)(?::\d+)?(/[^?#]*)?"
    host = F.lower(F.when(short != "", short).otherwise(F.regexp_extract(text, url, 1)))
    path = F.when(short != "", F.regexp_extract(text, r"^(?:[^@/]+@)?[^/:]+:([^/].*)$", 1)).otherwise(F.regexp_extract(text, url, 2))
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"(?i)\.git$", "")
    path = F.when(host.isin("github.com", "gitlab.com", "bitbucket.org"), F.lower(path)).otherwise(path)
    return F.when((host != "") & (path != ""), F.concat_ws("/", host, path))


def counter(value: Column) -> Column:
    """A counter of a log: whole and not negative; what is no number is 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0)).otherwise(F.greatest(F.lit(0), number.cast("long"))).cast("long")


def log_millis(value: Column) -> Column:
    """Milliseconds of a timestamp in a log: numbers above 1e11 are milliseconds, others seconds; text is ISO-8601.
    Null where it is invalid or not after 1970."""
    number = value.try_cast("double")
    ms = F.when(number.isNotNull(), F.when(number > 1e11, number).otherwise(number * 1000).cast("long")).otherwise(F.unix_millis(value.try_cast("timestamp")))
    return F.when(ms > 0, ms)


def model_label(model: Column) -> Column:
    """A display name; grouping, filters and exports keep the reported one."""
    known = r"^claude-(opus|sonnet|haiku|fable)-([0-9]+)(?:-([0-9]+))?(?:-(low|medium|high|max))?$"
    part = lambda n: F.regexp_extract(model, known, n)
    minor, effort = F.when(part(3) != "", F.concat(F.lit("."), part(3))).otherwise(""), F.when(part(4) != "", F.concat(F.lit(" ("), part(4), F.lit(")"))).otherwise("")
    named = F.concat(F.lit("Claude "), F.initcap(part(1)), F.lit(" "), part(2), minor, effort)
    return F.when(model == "cursor/unknown", "Unreported model").when(model.rlike(known), named).otherwise(F.regexp_replace(model, r"^cursor-grok-(?=[0-9])", "Grok "))


def csv_cell(value: Column) -> Column:
    """A quoted CSV cell; what a spreadsheet would take for a formula gets a leading apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def period_delta(now: Column, before: Column) -> tuple[Column, Column]:
    """Change against the previous period: its size as text ('new', '0%' or a whole percentage) and its direction; null
    where there is no previous period."""
    change = F.floor(100 * F.abs(now - before) / before + 0.5).cast("long").cast("string")
    size = F.when(before > 0, F.concat(change, F.lit("%"))).when(now > 0, "new").otherwise("0%")
    direction = F.when(now > before, "up").when(now < before, "down").otherwise("flat")
    return F.when(before.isNotNull(), size), F.when(before.isNotNull(), direction)


def share_text(value: Column, total: Column) -> Column:
    share = value / total * 100
    return F.when(F.coalesce(total, F.lit(0)) == 0, "—").when((share > 0) & (share < 1), "<1%").otherwise(F.concat(F.round(share).cast("long").cast("string"), F.lit("%")))


def numeric_sort_key(text: Column) -> Column:
    """Text without case and accents, whose runs of digits sort by value: each is padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
    return F.collate(padded, "UNICODE_CI_AI")


def safe_web_url(url: Column) -> Column:
    """An http or https address without credentials; null for anything else."""
    text = F.trim(url)
    host = F.try_parse_url(text, F.lit("HOST"))
    good = F.lower(F.coalesce(F.try_parse_url(text, F.lit("PROTOCOL")), F.lit(""))).isin("http", "https") & host.isNotNull() & F.try_parse_url(text, F.lit("USERINFO")).isNull()
    path = F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit(""))
    return F.when(good, F.when((path == "") & ~text.rlike(r"[?#]"), F.concat(text, F.lit("/"))).otherwise(text))


def native_thread_url(thread_id: Column, thread_url: Column, scheme: str) -> Column:
    """scheme://threads/<environment>/<thread> of a web route that ends in the environment and this very thread."""
    url = safe_web_url(thread_url)
    parts = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    at = lambda n: F.try_url_decode(F.try_element_at(parts, F.lit(n)))
    plain = lambda c: c.rlike("^[a-zA-Z0-9:_-]{1,512}$")
    good = F.try_parse_url(url, F.lit("QUERY")).isNull() & F.try_parse_url(url, F.lit("REF")).isNull() & plain(at(-2)) & plain(at(-1)) & (at(-1) == thread_id)
    return F.when(good, F.concat(F.lit(f"{scheme}://threads/"), at(-2), F.lit("/"), at(-1)))


def agent_url(harness: Column, session: Column) -> Column:
    return F.when((harness == "cursor") & session.rlike("^[a-zA-Z0-9_-]{1,256}$"), F.concat(F.lit("https://cursor.com/agents/"), session))


def repository_url(repository: Column) -> Column:
    url = safe_web_url(F.concat(F.lit("https://"), repository))
    path = F.try_parse_url(url, F.lit("PATH"))
    good = (repository != "") & ~repository.startswith("local:") & (path != "/") & F.try_parse_url(url, F.lit("QUERY")).isNull() & F.try_parse_url(url, F.lit("REF")).isNull()
    return F.when(good, url)


def session_name(title: Column, name: Column, key: Column) -> Column:
    """What a session is called: its title, its project's name, or the project's label."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(name), F.lit("")), project_label(key))


def collector_version(release: Column, build: Column) -> Column:
    """release+build, where the build is a plain identifier; 64 characters at most."""
    tag = F.trim(build)
    return F.substring(F.when(tag.rlike("^[0-9A-Za-z.-]{1,40}$"), F.concat(release, F.lit("+"), tag)).otherwise(release), 1, 64)


def nice_peak(value: Column) -> Column:
    """The top of an axis with four steps of a round size."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value / 4)))
    steps = F.filter(F.array(*[F.lit(x) for x in (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0)]), lambda x: x >= value / (4 * unit))
    return F.when(value <= 0, F.lit(1.0)).otherwise(4 * unit * F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit(10.0)))


def utc_iso(ms: Column) -> Column:
    """ISO text of milliseconds, whatever the session's time zone."""
    stamp = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
