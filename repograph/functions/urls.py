"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from repograph.functions.text import nonempty, strip

HOSTED = ("github", "gitlab", "bitbucket")


def repository_name(address: Column, repo_type: Column) -> Column:
    """`owner_repo` for hosted URLs, otherwise the last path part."""
    parts = F.split(F.regexp_replace(address, r"/+\z", ""), "/")
    last = F.replace(F.element_at(parts, -1), F.lit(".git"), F.lit(""))
    hosted = repo_type.isin(*HOSTED) & (F.size(parts) >= 5)
    return F.when(hosted, F.concat_ws("_", F.get(parts, F.size(parts) - 2), last)).otherwise(last)


def short_name(address: Column) -> Column:
    """Text after the last slash."""
    return F.element_at(F.split(address, "/"), -1)


def _with_scheme(address: Column) -> Column:
    return F.when(address.startswith("http"), address).otherwise(
        F.concat(F.lit("https://"), address))


def url_origin(address: Column) -> Column:
    """Scheme, host and explicit port; null for text that is no URL."""
    url = _with_scheme(address)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)\z", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(host.isNotNull() & (host != ""), F.concat(
        scheme, F.lit("://"), host,
        F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise("")))


def url_path(address: Column) -> Column:
    """Path without its first and its last slash."""
    url = _with_scheme(address)
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(host.isNotNull() & (host != ""), F.regexp_replace(path, r"\A/|/\z", ""))


def parse_repository(address: Column) -> Column:
    """Struct of owner, repo, type, full_path and local_path; null for unusable input."""
    text = strip(address)
    windows = text.rlike(r'\A[a-zA-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*\z')
    unix = text.startswith("/")
    hosted = text.rlike(r"\A(?:https?://)?[^/]+/.+?/[^/]+(?:\.git)?/?\z")
    origin, path = url_origin(text), F.regexp_replace(url_path(text), r"\.git\z", "")
    parts = F.split(path, "/")
    part_of = lambda n: F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - n))
    web_type = (F.when(origin.contains("github.com"), "github")
                .when(origin.contains("gitlab.com") | origin.contains("gitlab."), "gitlab")
                .when(origin.contains("bitbucket.org") | origin.contains("bitbucket."), "bitbucket")
                .otherwise("web"))
    unix_parts = F.filter(F.split(text, "/"), lambda p: p != "")
    local_repo = F.when(windows, F.element_at(F.split(text, r"\\"), -1)).otherwise(
        F.get(unix_parts, F.size(unix_parts) - 1))
    is_local = windows | unix
    owner = F.when(is_local, F.lit("local")).when(hosted, nonempty(strip(part_of(2))))
    repo = F.when(is_local, F.coalesce(nonempty(local_repo), F.lit("local-repo"))).when(
        hosted, nonempty(strip(part_of(1))))
    found = F.struct(
        owner.alias("owner"), F.regexp_replace(repo, r"\.git\z", "").alias("repo"),
        F.when(is_local, F.lit("local")).otherwise(web_type).alias("type"),
        F.when(~is_local, path).alias("full_path"),
        F.when(is_local, text).alias("local_path"))
    return F.when(owner.isNotNull() & repo.isNotNull(), found)


def file_url(repo_url: Column, repo_type: Column, branch: Column, path: Column) -> Column:
    """Link to a file on its hosting site; the bare path for local or unknown hosts."""
    host = F.lower(F.try_parse_url(repo_url, F.lit("HOST")))
    marker = (F.when(host.contains("github"), "/blob/")
              .when(host.contains("gitlab"), "/-/blob/")
              .when(host.contains("bitbucket"), "/src/"))
    link = F.concat(repo_url, marker, branch, F.lit("/"), path)
    return F.when(repo_type == "local", path).otherwise(F.coalesce(link, path))


def repository_url(repo_type: Column, local_path: Column, repo_url: Column, owner: Column,
                   repo: Column) -> Column:
    """Local path, given URL, made-up URL from owner and name, or nothing."""
    made_up = F.concat(F.lit("http://example/"), nonempty(owner), F.lit("/"), nonempty(repo))
    return F.coalesce(F.when(repo_type == "local", nonempty(local_path)), nonempty(repo_url),
                      made_up, F.lit(""))


def branches_to_try(default: Column) -> Column:
    """The default branch when it is known, then the usual names, each once."""
    usual = F.array(F.lit("main"), F.lit("master"))
    return F.array_distinct(F.concat(F.array_compact(F.array(nonempty(default))), usual))
