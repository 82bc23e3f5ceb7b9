"""Keys and repository names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a full repository name and of a hosting URL.
REPO_NAME = r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$"
HOST_URL = r"github\.com[/:]([^/\s]+/[^/\s#?]+)"

# Module path prefixes and the organisation that mirrors them.
MODULE_PREFIXES = (
    ("golang.org/x/", "golang"),
    ("k8s.io/", "kubernetes"),
    ("sigs.k8s.io/", "kubernetes-sigs"),
)


def event_key(kind: Column, actor: Column, repo: Column, created_at: Column) -> Column:
    """Deduplication key; concat_ws skips NULL parts, so it is never NULL."""
    return F.sha2(F.concat_ws("|", kind, actor, repo, created_at), 256)


def vector_key(repo: Column, report_file: Column) -> Column:
    """Stable id of a (repository, report) pair."""
    return F.substring(F.sha2(F.concat(repo, F.lit("|"), report_file), 256), 1, 40)


def org_of(repo: Column) -> Column:
    return F.get(F.split(repo, "/"), F.lit(0))


def name_of(repo: Column) -> Column:
    return F.get(F.split(repo, "/"), F.lit(1))


def valid_repo_name(repo: Column) -> Column:
    return repo.rlike(REPO_NAME)


def github_slug(url: Column) -> Column:
    """``org/repo`` of a hosting URL, else NULL."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^git\+", ""), r"\.git$", "")
    return F.nullif(F.regexp_extract(plain, HOST_URL, 1), F.lit(""))


def go_module_slug(path: Column) -> Column:
    """``org/repo`` behind a Go module path: mirrored prefixes first, then the URL rule."""
    slug = github_slug(path)
    for prefix, org in reversed(MODULE_PREFIXES):
        rest = F.substring(path, len(prefix) + 1, 2**30)
        slug = F.when(
            path.startswith(prefix), F.concat(F.lit(f"{org}/"), F.get(F.split(rest, "/"), F.lit(0)))
        ).otherwise(slug)
    return slug
