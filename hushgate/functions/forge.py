"""Code-host addresses, links, stored message payloads and change lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgate import schemas
from hushgate.functions.text import first_line, null_if_empty, or_empty
from hushgate.rules import API_BASES, BLANKS, CLONE_HOSTS


def _by_forge(forge: Column, choices: dict[str, Column], default: Column) -> Column:
    branch = F
    for name, value in choices.items():
        branch = branch.when(forge == name, value)
    return branch.otherwise(default)


# ---- addresses -----------------------------------------------------------

SCP_FORM = r"^git@([^:]*):?(.*)$"
URL_FORM = r"^(?:ssh|https?)://(?:[^@/]*@)?([^/]*)/?(.*)$"


def repo_url_parts(url: Column) -> Column:
    """Struct of protocol, host, owner, repo and full; all empty if unknown."""
    u = F.btrim(or_empty(url), F.lit(BLANKS))
    is_scp = u.startswith("git@")
    protocol = (F.when(is_scp | u.startswith("ssh://"), F.lit("ssh"))
                 .when(u.startswith("https://"), F.lit("https"))
                 .when(u.startswith("http://"), F.lit("http"))
                 .otherwise(F.lit("")))
    host = F.when(is_scp, F.regexp_extract(u, SCP_FORM, 1)).otherwise(F.regexp_extract(u, URL_FORM, 1))
    path = F.when(is_scp, F.regexp_extract(u, SCP_FORM, 2)).otherwise(F.regexp_extract(u, URL_FORM, 2))
    path = F.regexp_replace(path, r"\.git$", "")
    nested = path.contains("/")
    owner = F.when(nested, F.substring_index(path, "/", 1)).otherwise(F.lit(""))
    repo = F.when(nested, F.regexp_extract(path, r"^[^/]*/(.*)$", 1)).otherwise(F.lit(""))
    full = F.when(protocol == "", F.lit("")).otherwise(F.concat(host, F.lit("/"), path))
    return F.struct(protocol.alias("protocol"), host.alias("host"), owner.alias("owner"),
                    repo.alias("repo"), full.alias("full"))


HOST_WORDS = [("github", "github"), ("gitlab", "gitlab"), ("gitea", "gitea"), ("gogs", "gitea"),
              ("bitbucket", "bitbucket"), ("azure", "azure_devops")]


def forge_of_host(host: Column) -> Column:
    h = F.lower(or_empty(host))
    branch = F
    for word, forge in HOST_WORDS:
        branch = branch.when(h.contains(word), F.lit(forge))
    return branch.otherwise(F.lit("unknown"))


def azure_project_repo(repo: Column) -> Column:
    """Struct of project and repo out of ``project/_git/repo``."""
    split_at = F.instr(repo, "/_git/")
    project = F.when(split_at > 0, F.left(repo, split_at - 1)).otherwise(repo)
    name = F.when(split_at > 0, F.substr(repo, split_at + 6)).otherwise(repo)
    return F.struct(project.alias("project"), name.alias("repo"))


# ---- link columns --------------------------------------------------------

def clone_url(repo: Column, forge: Column) -> Column:
    host = _by_forge(forge, {f: F.lit(h) for f, h in CLONE_HOSTS.items()}, forge)
    return F.concat(F.lit("https://"), host, F.lit("/"), repo, F.lit(".git"))


def api_base(forge: Column) -> Column:
    return _by_forge(forge, {f: F.lit(b) for f, b in API_BASES.items()}, F.lit(API_BASES["github"]))


def _owner_and_name(repo: Column) -> tuple[Column, Column]:
    return F.substring_index(repo, "/", 1), F.substring_index(repo, "/", -1)


def commit_url(repo: Column, sha: Column, forge: Column) -> Column:
    owner, name = _owner_and_name(repo)
    tail = _by_forge(forge, {
        "gitlab": F.format_string("/projects/%s%%2F%s/repository/commits/%s", owner, name, sha),
        "bitbucket": F.format_string("/repositories/%s/%s/commit/%s", owner, name, sha),
        "azure_devops": F.format_string(
            "/%s/%s/_apis/git/repositories/%s/commits/%s?api-version=7.0", owner, name, name, sha),
        "sourceforge": F.format_string("/p/%s/%s/git/commits/%s", owner, name, sha),
    }, F.format_string("/repos/%s/%s/commits/%s", owner, name, sha))
    return F.concat(api_base(forge), tail)


def diff_url(repo: Column, sha: Column, forge: Column) -> Column:
    """Link to the diff of a commit, or of a pull request for ``pr-<n>`` keys.

    On the hosts whose commit link carries a query string the path suffix goes
    in front of it.
    """
    owner, name = _owner_and_name(repo)
    number = F.substr(sha, F.lit(4))
    pull = F.format_string("/repos/%s/%s/pulls/%s", owner, name, number)
    of_pull = F.concat(api_base(forge), _by_forge(forge, {
        "github": pull,
        "gitlab": F.format_string("/projects/%s%%2F%s/merge_requests/%s/diffs", owner, name, number),
        "gitea": F.concat(pull, F.lit(".diff")),
        "gogs": F.concat(pull, F.lit(".diff")),
    }, F.format_string("/repos/%s/%s/commits/%s", owner, name, sha)))
    commit = commit_url(repo, sha, forge)
    bare = F.substring_index(commit, "?", 1)
    of_commit = _by_forge(forge, {
        "gitlab": F.concat(commit, F.lit("/diff")),
        "bitbucket": F.concat(commit, F.lit("/diff")),
        "azure_devops": F.concat(bare, F.lit("/changes?api-version=7.0")),
    }, commit)
    return F.when(sha.startswith("pr-"), of_pull).otherwise(of_commit)


# ---- stored payloads -----------------------------------------------------

def message_by_forge(forge: Column, body: Column) -> Column:
    """First line of the commit message held in a stored payload."""
    def at(path: str) -> Column:
        return F.get_json_object(body, path)

    message = _by_forge(forge, {
        "gitlab": at("$.message"),
        "bitbucket": at("$.summary.raw"),
        "azure_devops": at("$.comment"),
        "sourceforge": F.coalesce(null_if_empty(at("$.message")), at("$.title")),
    }, at("$.commit.message"))
    return first_line(message)


def _join_changes(changes: Column, old, new, file_lines: bool) -> Column:
    def text(change: Column) -> Column:
        a, b = or_empty(old(change)), or_empty(new(change))
        lines = [F.concat(F.lit("diff --git a/"), a, F.lit(" b/"), b)]
        if file_lines:
            lines += [F.concat(F.lit("--- a/"), a), F.concat(F.lit("+++ b/"), b)]
        return F.concat_ws("\n", *lines, null_if_empty(change["diff"]))

    return F.array_join(F.transform(changes, text), "\n")


def assemble_diff(forge: Column, body: Column) -> Column:
    """Unified diff text out of a stored change list; other bodies pass through."""
    gitlab = _join_changes(F.from_json(body, schemas.GITLAB_CHANGES),
                           lambda c: c["old_path"], lambda c: c["new_path"], True)
    paged = F.from_json(body, schemas.BITBUCKET_PAGE)["values"]
    listed = F.from_json(body, schemas.BITBUCKET_CHANGES)
    bitbucket = _join_changes(
        F.when(F.ltrim(body).startswith("["), listed).otherwise(paged),
        lambda c: c["old"]["path"], lambda c: c["new"]["path"], False)
    azure = _join_changes(F.from_json(body, schemas.AZURE_PAGE)["changes"],
                          lambda c: c["item"]["path"], lambda c: c["item"]["path"], False)
    assembled = _by_forge(forge, {
        "gitlab": gitlab,
        "bitbucket": bitbucket,
        "azure_devops": null_if_empty(azure),
    }, body)
    return F.coalesce(assembled, body)

