"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

import re

from hushgate import rules
from hushgate.catalog.queries import CUSTOM_WORDS, FORGES
from hushgate.catalog.views import INVENTED, MESSAGES, SALT
from hushgate.functions.verdict import WORD_SETS
from hushgate.operators.detect import DETECTOR_CATALOG, GENERIC_DETECTORS


# ---- SQL text helpers ----------------------------------------------------

def q(text: str) -> str:
    """SQL literal."""
    if re.search(r"[\x00-\x1f]", text):
        body = text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
        return f"E'{body}'"
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]" if values else "CAST([] AS VARCHAR[])"


def pick(values, index: str) -> str:
    return f"({sql_list(values)})[CAST(({index}) % {len(values)} + 1 AS INT)]"


NL = "chr(10)"


def first_line(m: str) -> str:
    return f"nullif(split_part({m}, {NL}, 1), '')"


def key_of(m: str) -> str:
    return f"lower(trim(coalesce({m}, ''), E' \\t\\n\\r'))"


def tokens_of(key: str) -> str:
    return f"list_distinct(regexp_extract_all({key}, {q(rules.TOKEN_PATTERN)}))"


def overlap(tokens: str, words) -> str:
    return f"list_has_any({tokens}, {sql_list(words)})"


def tier1_of(tokens: str, sets=WORD_SETS) -> str:
    return f"({overlap(tokens, sets['high_verbs'])} AND {overlap(tokens, sets['high_nouns'])})"


def tier2_of(tokens: str, sets=WORD_SETS) -> str:
    return f"({overlap(tokens, sets['broad_verbs'])} AND {overlap(tokens, sets['broad_nouns'])})"


PATTERNS = rules.REMOVAL_PATTERNS + rules.SWEEP_PATTERNS


def when_patterns(key: str, ids) -> str:
    return " ".join(f"WHEN regexp_matches({key}, {q(PATTERNS[i - 1])}) THEN {i}" for i in ids)


def code_of(key: str, sets=WORD_SETS) -> str:
    t = tokens_of(key)
    return (f"CASE WHEN {key} = '' THEN -1 {when_patterns(key, range(1, 13))} "
            f"WHEN {tier1_of(t, sets)} THEN 101 WHEN {tier2_of(t, sets)} THEN 102 ELSE 0 END")


CLASS_COLUMNS = """
  CASE WHEN code > 0 THEN 'suspicious' ELSE 'clean' END AS classification,
  CASE code WHEN -1 THEN 'blank' WHEN 0 THEN 'none' WHEN 101 THEN 'tier1' WHEN 102 THEN 'tier2'
       ELSE 'pattern' END AS tier,
  CASE WHEN code BETWEEN 1 AND 12 THEN code END AS rule_id"""


def re2(pattern: str) -> str:
    """The same pattern in the dialect of DuckDB."""
    return (pattern.replace(rules.NOT_AFTER_WORD, r"\b").replace(rules.NOT_BEFORE_WORD, r"\b")
            .replace(r"\p{XDigit}", "[0-9a-fA-F]"))


def hits(source: str, keys: str, text: str = "text") -> str:
    """Matches of all detectors: keys, detector, pos, value."""
    parts = [
        f"SELECT {keys}, {q(d.name)} AS detector, unnest(range(len(m))) AS pos, unnest(m) AS value "
        f"FROM (SELECT {keys}, regexp_extract_all({text}, {q(re2(d.pattern))}, 1) AS m FROM {source})"
        for d in rules.DETECTORS]
    return " UNION ALL ".join(parts)


def fp(value: str) -> str:
    return f"sha256({q(SALT)} || {value})"


def red(value: str) -> str:
    return f"left({value}, CASE WHEN length({value}) < 12 THEN 0 ELSE least(4, length({value}) // 4) END) || '...'"


def redacted(text: str) -> str:
    for d in rules.DETECTORS:
        text = f"regexp_replace({text}, {q(re2(d.replacing))}, {q(chr(92) + '1' + rules.MASK + chr(92) + '2')}, 'g')"
    return text


def shorten(text: str, width: int = 60) -> str:
    flat = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return (f"CASE WHEN length({flat}) > {width} THEN "
            f"regexp_extract({flat}, '^(.{{0,{width - 3}}})(\\s|$)', 1) || '...' ELSE {flat} END")


def domain_of(email: str) -> str:
    e = f"trim(coalesce({email}, ''))"
    return f"CASE WHEN contains({e}, '@') THEN lower(list_last(string_split({e}, '@'))) ELSE '' END"


def by_case(column: str, choices: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {x}" for k, x in choices.items()) + f" ELSE {default} END"


def lines(section: int, texts: list[str], source: str, condition: str = "true") -> str:
    """Fixed report lines, each text being an SQL expression."""
    return " UNION ALL ".join(
        f"SELECT {section} AS section, {i} AS pos, {t} AS line FROM {source} WHERE {condition}"
        for i, t in enumerate(texts))


# ---- shared views --------------------------------------------------------

NAME = "(CASE WHEN user_id % 3 = 0 THEN 'Org' ELSE 'org' END || (user_id % 25) || '/repo' || (user_id % 7))"

VIEWS = {
    "ev": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "ce": f"""SELECT event_id, ts, user_id, k,
        CASE event_type WHEN 'error' THEN 'IssuesEvent' WHEN 'signup' THEN 'PullRequestEvent' ELSE 'PushEvent' END AS kind,
        CASE WHEN event_id % 41 = 5 THEN 'solo' WHEN event_id % 43 = 7 THEN {NAME} || '/sub'
             WHEN event_id % 47 = 9 THEN '' ELSE {NAME} END AS repo,
        CASE WHEN event_id % 53 = 11 THEN '' ELSE md5(user_id || '-' || k) END AS sha,
        {pick(MESSAGES, 'k')} AS message FROM ev""",
    "pushes": """SELECT event_id, repo, date_trunc('second', ts) AS ts, 'push' AS event_type, sha AS head,
        CASE WHEN k % 17 <> 3 THEN (['refs/heads/main', 'refs/heads/dev'])[CAST(k % 2 + 1 AS INT)] ELSE '' END AS ref
        FROM ce WHERE kind = 'PushEvent'""",
    "prs": """SELECT event_id, repo, date_trunc('second', ts) AS ts, 'pr' AS event_type, message AS title,
        event_id AS pr_number, 'https://forge.example/' || repo || '/pull/' || event_id AS pr_url,
        (['opened', 'reopened'])[CAST(event_id % 3 + 1 AS INT)] AS action
        FROM ce WHERE kind = 'PullRequestEvent' AND event_id % 3 < 2""",
    "keyed": """SELECT event_id, repo, ts, event_type, head AS sha, NULL AS message, false AS is_pr, ref, '' AS pr_url
        FROM pushes WHERE head <> '' AND len(string_split(repo, '/')) = 2
        UNION ALL SELECT event_id, repo, ts, event_type, 'pr-' || pr_number, title, true, '', pr_url
        FROM prs WHERE repo <> '' AND title <> ''""",
    "push_keys": """SELECT DISTINCT repo, sha, user_id, k, message FROM ce WHERE kind = 'PushEvent' AND sha <> ''""",
    "commits": "SELECT repo, sha, message FROM push_keys WHERE k % 10 <> 0",
    "resolved": f"""SELECT p.event_id, p.repo, p.ts, p.sha, p.is_pr, p.ref, p.pr_url, {first_line('c.message')} AS message
        FROM keyed p JOIN commits c ON p.repo = c.repo AND p.sha = c.sha
        WHERE NOT p.is_pr AND {first_line('c.message')} IS NOT NULL
        UNION ALL SELECT event_id, repo, ts, sha, is_pr, ref, pr_url, message FROM keyed WHERE is_pr""",
    "classified": f"""SELECT *, {CLASS_COLUMNS} FROM (SELECT *, {code_of(key_of('message'))} AS code FROM resolved)""",
    "suspicious": "SELECT * FROM classified WHERE classification = 'suspicious'",
    "diffs": f"""SELECT p.repo, p.sha, 'diff --git a/' || source || '.txt b/' || source || '.txt' || {NL}
        || '--- a/' || source || '.txt' || {NL}
        || CASE WHEN doc_id % 3 = 1 THEN '+++ /dev/null' || {NL} || '@@ -1,' || len(string_split(text, {NL})) || ' +0,0 @@'
                || {NL} || '-' || replace(text, {NL}, {NL} || '-')
           ELSE '+++ b/' || source || '.txt' || {NL} || '@@ -1 +1,' || len(string_split(text, {NL})) || ' @@' || {NL}
                || ' first line' || {NL} || '+' || replace(text, {NL}, {NL} || '+') END AS diff
        FROM push_keys p JOIN documents d ON d.doc_id = (p.user_id * 100 + p.k) % (SELECT count(*) FROM documents)""",
    "wanted": "SELECT DISTINCT repo, sha FROM suspicious WHERE len(string_split(repo, '/')) = 2",
    "attached": "SELECT d.repo, d.sha, d.diff FROM diffs d JOIN wanted w ON d.repo = w.repo AND d.sha = w.sha",
    "orgs": "SELECT 'org' || n_nationkey AS handle FROM nation WHERE n_nationkey % 2 = 0",
    "mails": "SELECT 'mail' || n_nationkey || '.example' AS domain FROM nation WHERE n_nationkey IN (1, 3, 5)",
    "emails": """SELECT event_id, unnest([0, 1]) AS pos,
        unnest(['u' || user_id || '@Mail' || (user_id % 7) || '.example',
                CASE WHEN k % 3 <> 0 THEN 'x@y@mail' || ((user_id + k) % 7) || '.example ' END]) AS author,
        unnest([CASE WHEN k % 2 = 0 THEN 'bot' ELSE 'c' || k || '@mail' || (k % 7) || '.example' END,
                'z@mail' || (k % 5) || '.example']) AS committer
        FROM ce WHERE kind = 'PushEvent' AND k % 11 <> 0""",
    "named": f"""SELECT event_id, pos * 2 AS pos, 'author_domain' AS via, {domain_of('author')} AS domain FROM emails
        UNION ALL SELECT event_id, pos * 2 + 1, 'committer_domain', {domain_of('committer')} FROM emails""",
    "mail_hits": """SELECT event_id, arg_min(via, pos) AS via, arg_min(domain, pos) AS domain
        FROM named WHERE domain IN (SELECT domain FROM mails) GROUP BY event_id""",
    "org_hits": """SELECT event_id, repo, org_handle,
        coalesce(lower(org_handle) IN (SELECT handle FROM orgs), false) AS org_owned
        FROM (SELECT *, CASE WHEN contains(repo, '/') THEN split_part(repo, '/', 1) END AS org_handle FROM ce)""",
    "attributed": """SELECT CAST(o.event_id AS VARCHAR) AS id, org_handle, o.event_id,
        org_owned OR (org_handle IS NOT NULL AND m.via IS NOT NULL) AS is_owned,
        CASE WHEN org_owned THEN 'org_handle' WHEN org_handle IS NOT NULL THEN m.via END AS matched_via,
        CASE WHEN org_owned THEN org_handle WHEN org_handle IS NOT NULL THEN m.domain END AS matched_value,
        CASE WHEN org_handle IS NULL THEN 'unknown' WHEN org_owned THEN 'Org: ' || org_handle
             WHEN m.domain IS NOT NULL THEN 'Domain: ' || m.domain ELSE 'general-stream' END AS label
        FROM org_hits o LEFT JOIN mail_hits m ON o.event_id = m.event_id""",
    "page_texts": """SELECT page_id, url, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'),
        '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS text FROM pages""",
    "doc_hits": hits("documents", "doc_id, source"),
    "page_hits": hits("page_texts", "page_id"),
    "findings": f"""SELECT detector, l.verified, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp,
        md5(CAST(h.doc_id AS VARCHAR)) AS commit, source || '.txt' AS file, 'org' || (h.doc_id % 25) || '/docs' AS repository,
        CASE WHEN h.doc_id % 4 = 0 THEN '' ELSE 'd' || (h.doc_id % 50) || '@mail.example' END AS email,
        't' || left(md5(CAST(h.doc_id AS VARCHAR)), 6) AS "timestamp"
        FROM doc_hits h LEFT JOIN (SELECT doc_id, true AS verified FROM labels WHERE quality = 1) l ON h.doc_id = l.doc_id
        UNION ALL SELECT detector, NULL, pos, {red('value')}, {fp('value')}, md5('p' || page_id), page_id || '.html',
        'org' || (page_id % 25) || '/pages', '', 't' || left(md5('p' || page_id), 6) FROM page_hits""",
    "verified_counts": """SELECT detector, count(*) AS findings FROM findings WHERE verified
        GROUP BY detector""",
    "msgs": f"SELECT event_id, ts, sha, user_id, message, {key_of('message')} AS message_key FROM ce",
    "domain_texts": f"""SELECT page_id, unnest([url, 'it@corp' || (page_id % 40) || '.co.uk']) AS line FROM pages""",
    "found_domains": f"""SELECT DISTINCT domain FROM (
        SELECT unnest(regexp_extract_all(lower(trim(line)), {q(rules.DOMAIN_PATTERN)}, 1)) AS domain
        FROM domain_texts WHERE NOT contains(lower(line), 'domain'))
        WHERE domain NOT IN ({', '.join(q(d) for d in rules.FREEMAIL_DOMAINS)})""",
    "urls": f"""SELECT 'p' || page_id AS id, url FROM pages UNION ALL
        SELECT 'e' || event_id, CASE event_id % 6 WHEN 0 THEN 'git@' || host || ':' || repo || '.git'
          WHEN 1 THEN 'ssh://git@' || host || '/' || repo || '.git' WHEN 2 THEN 'https://' || host || '/' || repo || '.git '
          WHEN 3 THEN 'http://' || host || '/group/' || repo WHEN 4 THEN 'https://' || host || '/acme/proj/_git/' || repo
          ELSE 'not a url ' || repo END
        FROM (SELECT *, {pick(["github.com", "gitlab.example", "gitea.example", "gogs.example", "bitbucket.org",
                               "dev.azure.com", "Code.Example"], 'event_id')} AS host FROM ce)""",
    "url_cut": r"""SELECT id, protocol, host, regexp_replace(rest, '\.git$', '') AS path FROM (
        SELECT id, CASE WHEN starts_with(u, 'git@') OR starts_with(u, 'ssh://') THEN 'ssh'
            WHEN starts_with(u, 'https://') THEN 'https' WHEN starts_with(u, 'http://') THEN 'http' ELSE '' END AS protocol,
          CASE WHEN starts_with(u, 'git@') THEN regexp_extract(u, '^git@([^:]*):?(.*)$', 1)
            ELSE regexp_extract(u, '^(?:ssh|https?)://(?:[^@/]*@)?([^/]*)/?(.*)$', 1) END AS host,
          CASE WHEN starts_with(u, 'git@') THEN regexp_extract(u, '^git@([^:]*):?(.*)$', 2)
            ELSE regexp_extract(u, '^(?:ssh|https?)://(?:[^@/]*@)?([^/]*)/?(.*)$', 2) END AS rest
        FROM (SELECT id, trim(url) AS u FROM urls))""",
    "url_parts": """SELECT id, protocol, host,
        CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS owner,
        CASE WHEN contains(path, '/') THEN substr(path, instr(path, '/') + 1) ELSE '' END AS repo,
        CASE WHEN protocol = '' THEN '' ELSE host || '/' || path END AS "full" FROM url_cut""",
    "forged": f"""SELECT event_id, repo, {pick(FORGES, 'event_id')} AS forge, split_part(repo, '/', 1) AS owner,
        list_last(string_split(repo, '/')) AS name,
        CASE WHEN event_id % 3 = 0 THEN 'pr-' || event_id ELSE sha END AS sha FROM ce""",
    "open_keys": f"""SELECT DISTINCT message_key || ' ' || user_id AS message_key FROM
        (SELECT message_key, user_id, {code_of('message_key')} AS code FROM msgs) WHERE code = 0""",
    "numbered": """SELECT _bucket || '-' || (_pos // 10) AS batch_id, CAST(_pos % 10 AS INT) AS idx, message_key FROM (
        SELECT *, row_number() OVER (PARTITION BY _bucket ORDER BY message_key) - 1 AS _pos FROM (
          SELECT message_key, CAST('0x' || left(md5(message_key), 8) AS BIGINT) % 8 AS _bucket FROM open_keys))""",
    "batches": f"""SELECT batch_id, count(*) AS messages,
        replace({q(rules.REVIEW_BATCH_PROMPT)}, '{{messages}}',
          string_agg('[' || idx || '] ' || {redacted('message_key')}, {NL} || '---' || {NL} ORDER BY idx)) AS prompt
        FROM numbered GROUP BY batch_id""",
    "summary": """SELECT * FROM (SELECT min(ts) AS start_time, max(ts) AS end_time,
          (date_diff('microsecond', min(ts), max(ts)) // 1000000) || 's' AS duration,
          count(DISTINCT date_trunc('hour', ts)) AS hours_scanned, count(*) AS commits_seen,
          count(*) FILTER (classification = 'suspicious') AS suspicious_count FROM classified),
        (SELECT count(*) FILTER (verified) AS verified_count, count(*) AS total_findings FROM findings)""",
    "stats": """SELECT count(*) FILTER (code BETWEEN 1 AND 12) AS patterns, count(*) FILTER (code = 101) AS regex_tier1,
          count(*) FILTER (code = 102) AS regex_tier2, 0 AS llm, sum(n) - count(*) AS cache_hit
        FROM (SELECT *, %s AS code FROM (SELECT %s AS message_key, count(*) AS n FROM resolved GROUP BY 1)
              WHERE message_key <> '')""" % (code_of("message_key"), key_of("message")),
    "sampled20": """SELECT detector, repository, left(commit, 12) AS commit, file, rn FROM (SELECT *,
        row_number() OVER (ORDER BY "timestamp", repository, commit, file, detector, secret_fp) AS rn
        FROM findings WHERE verified) WHERE rn <= 20""",
    "listed": f"""SELECT repo, left(sha, 12) AS sha, {shorten(redacted('message'))} AS message FROM suspicious
        ORDER BY ts, repo, sha, event_id LIMIT 30""",
    "diff_lines": f"""SELECT repo, sha, unnest(string_split(diff, {NL})) AS line,
        unnest(range(len(string_split(diff, {NL})))) AS pos FROM diffs""",
    "diff_marked": """SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git ')
          THEN regexp_extract(line, ' b/(.*)$', 1) END IGNORE NULLS) OVER w AS file,
        last_value(CASE WHEN starts_with(line, '@@ ') THEN pos END IGNORE NULLS) OVER w AS hunk,
        last_value(CASE WHEN starts_with(line, '@@ ') THEN regexp_extract(line, '-([0-9]+)', 1) END IGNORE NULLS) OVER w AS old,
        last_value(CASE WHEN starts_with(line, '@@ ') THEN regexp_extract(line, '\\+([0-9]+)', 1) END IGNORE NULLS) OVER w AS new
        FROM diff_lines WINDOW w AS (PARTITION BY repo, sha ORDER BY pos)""",
    "changed": """SELECT repo, sha, file, left(line, 1) AS sign, substr(line, 2) AS text,
        CASE WHEN starts_with(line, '+') THEN CAST(new AS INT) + count(*) FILTER (NOT starts_with(line, '-')) OVER h - 1
             ELSE CAST(old AS INT) + count(*) FILTER (NOT starts_with(line, '+')) OVER h - 1 END AS line_no
        FROM diff_marked WHERE pos > hunk WINDOW h AS (PARTITION BY repo, sha, hunk ORDER BY pos)""",
    "added": "SELECT repo, sha, file, line_no, text FROM changed WHERE sign = '+'",
    "stored": """SELECT repo, sha, user_id, k, message, TIMESTAMP '2024-01-01' + to_days(CAST(k % 28 AS INT)) AS commit_at
        FROM push_keys""",
    "live": f"""SELECT e.event_id, e.repo, e.sha, e.ts, {first_line('s.message')} AS message, s.user_id, s.k
        FROM keyed e JOIN attributed a ON a.event_id = e.event_id AND a.is_owned
        LEFT JOIN stored s ON s.repo = e.repo AND s.sha = e.sha AND s.k % 10 <> 0 AND {first_line('s.message')} IS NOT NULL
          AND s.commit_at BETWEEN e.ts - INTERVAL 10 DAY AND e.ts + INTERVAL 5 DAY WHERE NOT e.is_pr""",
    "live_wanted": f"""SELECT repo, sha, user_id, k, (user_id + k) % 7 <> 0 AS has_diff
        FROM (SELECT *, {code_of(key_of('message'))} AS code FROM live WHERE message IS NOT NULL) WHERE code > 0 GROUP BY ALL""",
}


def sql(body: str) -> str:
    """The body with the shared views it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s*(?:$|WHERE|\)))", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    ordered = [n for n in VIEWS if n in needed]
    if not ordered:
        return body
    # DuckDB resolves WITH entries in order, so views come after what they use.
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in ordered:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", VIEWS[name]):
                place(other)
        done.append(name)

    for name in ordered:
        place(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in done) + "\n" + body


# ---- one body per query --------------------------------------------------

def forge_of(host: str) -> str:
    h = f"lower({host})"
    words = [("github", "github"), ("gitlab", "gitlab"), ("gitea", "gitea"), ("gogs", "gitea"),
             ("bitbucket", "bitbucket"), ("azure", "azure_devops")]
    return "CASE " + " ".join(f"WHEN contains({h}, '{w}') THEN '{f}'" for w, f in words) + " ELSE 'unknown' END"


API = by_case("forge", {f: q(b) for f, b in rules.API_BASES.items()}, q(rules.API_BASES["github"]))
PROJECT = "'/projects/' || owner || '%2F' || name"
REPOS = "'/repos/' || owner || '/' || name"
AZURE = "'/' || owner || '/' || name || '/_apis/git/repositories/' || name || '/commits/' || sha"
COMMIT_TAIL = {
    "gitlab": f"{PROJECT} || '/repository/commits/' || sha",
    "bitbucket": "'/repositories/' || owner || '/' || name || '/commit/' || sha",
    "azure_devops": f"{AZURE} || '?api-version=7.0'",
    "sourceforge": "'/p/' || owner || '/' || name || '/git/commits/' || sha",
}
OF_COMMIT = by_case("forge", COMMIT_TAIL, f"{REPOS} || '/commits/' || sha")
DIFF_OF_COMMIT = by_case("forge", {
    **COMMIT_TAIL, "gitlab": COMMIT_TAIL["gitlab"] + " || '/diff'", "bitbucket": COMMIT_TAIL["bitbucket"] + " || '/diff'",
    "azure_devops": f"{AZURE} || '/changes?api-version=7.0'"}, f"{REPOS} || '/commits/' || sha")
DIFF_OF_PULL = by_case("forge", {
    "github": f"{REPOS} || '/pulls/' || substr(sha, 4)",
    "gitlab": f"{PROJECT} || '/merge_requests/' || substr(sha, 4) || '/diffs'",
    "gitea": f"{REPOS} || '/pulls/' || substr(sha, 4) || '.diff'",
    "gogs": f"{REPOS} || '/pulls/' || substr(sha, 4) || '.diff'"}, f"{REPOS} || '/commits/' || sha")

LABELLED = f"SELECT event_id, {CLASS_COLUMNS} FROM (SELECT event_id, {{code}} AS code FROM msgs)"
IN_HOURS = "ts >= TIMESTAMP '2024-01-10 03:00:00' AND ts < TIMESTAMP '2024-01-12 05:00:00'"
BROKEN = "'{\"type\": \"' || kind || '\", \"id\": ' || event_id"

PATCH = f"'@@ -0,0 +1 @@' || {NL} || '+' || replace(text, {NL}, {NL} || '+')"
GIT_HEAD = f"'diff --git a/' || {{a}} || ' b/' || {{b}} || {NL}"
OLD, NEW = "(source || '.old')", "(source || '.txt')"
GITLAB_DIFF = (GIT_HEAD.format(a=OLD, b=NEW) + f" || '--- a/' || {OLD} || {NL} || '+++ b/' || {NEW} || {NL} || {PATCH} || {NL} || "
               + GIT_HEAD.format(a=OLD, b=OLD) + f" || '--- a/' || {OLD} || {NL} || '+++ b/' || {OLD}")

FACTS = ["hours_scanned", "commits_seen", "suspicious_count", "verified_count", "total_findings"]

MARKDOWN = " UNION ALL ".join([
    lines(0, ["'# Secret Scan Report'", "''",
              "'**Scan period:** ' || CAST(start_time AS VARCHAR) || ' — ' || CAST(end_time AS VARCHAR)",
              "'**Duration:** ' || duration", "'**Hours scanned:** ' || hours_scanned",
              "'**Commits seen:** ' || format('{:,}', commits_seen)",
              "'**Suspicious commits flagged:** ' || suspicious_count",
              "'**Verified secrets found:** ' || verified_count", "'**Total findings:** ' || total_findings", "''"], "summary"),
    lines(1, ["'## Verified Findings by Detector'", "''", "'| Detector | Count |'", "'|----------|-------|'"],
          "summary", "total_findings > 0"),
    """SELECT 2, row_number() OVER (ORDER BY findings DESC, detector) - 1,
       '| ' || detector || ' | ' || findings || ' |' FROM verified_counts""",
    lines(3, ["''", "'## Sample Verified Findings'", "''", "'| Detector | Repository | Commit | File |'",
              "'|----------|------------|--------|------|'"], "summary", "total_findings > 0"),
    """SELECT 4, row_number() OVER (ORDER BY repository, commit, file, detector) - 1,
       '| ' || detector || ' | ' || repository || ' | `' || commit || '` | ' || file || ' |' FROM sampled20""",
    lines(5, ["''", "'## Suspicious Commits (by message classification)'", "''", "'| Repository | Commit | Message |'",
              "'|------------|--------|---------|'"], "summary", "suspicious_count > 0"),
    """SELECT 6, row_number() OVER (ORDER BY repo, sha, message) - 1,
       '| ' || repo || ' | `' || sha || '` | ' || message || ' |' FROM listed""",
])

BAR = q("═" * 72)
TEXT = " UNION ALL ".join([
    lines(0, [BAR, "'  Secret Scan Report'", BAR, "'  Scanned hours : ' || hours_scanned",
              "'  Commits seen  : ' || format('{:,}', commits_seen)", "'  Suspicious    : ' || suspicious_count",
              "'  Verified      : ' || verified_count", "'  Total findings: ' || total_findings",
              "'  Duration      : ' || duration"], "summary"),
    lines(1, ["''", "'  Classifier stats:'"] + [f"'    {s}: ' || {s}" for s in
              ["patterns", "regex_tier1", "regex_tier2", "llm", "cache_hit"]], "stats"),
    lines(2, ["''", "'  Top detectors (verified):'"], "summary", "total_findings > 0"),
    """SELECT 3, row_number() OVER (ORDER BY findings DESC, detector) - 1, '    ' || detector || ': ' || findings
       FROM (SELECT * FROM verified_counts ORDER BY findings DESC, detector LIMIT 10)""",
    lines(4, ["''", "'  Sample verified findings:'"], "summary", "total_findings > 0"),
    """SELECT 5, row_number() OVER (ORDER BY repository, commit, file, detector) - 1,
       '    [' || detector || '] ' || repository || ' @ ' || commit || '  (' || file || ')' FROM sampled20 WHERE rn <= 5""",
    lines(9, [BAR], "summary"),
])


def json_of(section: str, fields: dict[str, str], source: str) -> str:
    packed = ", ".join(f"{name} := {expr}" for name, expr in fields.items())
    return f"SELECT {q(section)} AS section, CAST(to_json(struct_pack({packed})) AS VARCHAR) AS body FROM {source}"


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


JSON = " UNION ALL ".join([
    json_of("summary", {"start_time": "CAST(start_time AS VARCHAR)", "end_time": "CAST(end_time AS VARCHAR)",
                        "duration": "duration", **same(*FACTS)}, "summary"),
    json_of("suspicious_commits", {**same("repo", "sha"), "message": redacted("message"), **same("classification"),
                                   "timestamp": "CAST(ts AS VARCHAR)"}, "suspicious"),
    json_of("findings", {**same("detector"), "verified": "coalesce(verified, false)",
                         **same("commit", "file", "repository", "email", "secret_redacted", "secret_fp")}, "findings"),
    json_of("classifier_stats", {s: f"CAST({s} AS BIGINT)" for s in
                                 ["patterns", "regex_tier1", "regex_tier2", "llm", "cache_hit"]}, "stats"),
])

BODIES: dict[str, str] = {
    "suspicious_per_org": """SELECT CASE WHEN contains(repo, '/') THEN lower(split_part(repo, '/', 1)) END AS org, tier,
        count(*) AS commits FROM suspicious GROUP BY ALL""",
    # sources and sinks
    "read_archive_events": """SELECT CAST(event_id AS VARCHAR) AS id, kind AS type,
        strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, repo, CASE WHEN kind = 'PushEvent' THEN sha END AS head,
        CASE WHEN kind = 'PushEvent' AND k % 17 <> 3 THEN (['refs/heads/main', 'refs/heads/dev'])[CAST(k % 2 + 1 AS INT)] END AS ref,
        CASE WHEN kind = 'PullRequestEvent' THEN (['opened', 'reopened', 'closed'])[CAST(event_id % 3 + 1 AS INT)] END AS action,
        CASE WHEN kind = 'PullRequestEvent' THEN event_id END AS pr_number,
        CASE WHEN kind <> 'PushEvent' THEN -1 WHEN k % 11 = 0 THEN 0 ELSE 2 END AS n_commits
        FROM ce WHERE event_id % 50 <> 7""",
    "archive_errors": """SELECT kind AS what, '' AS error, count(*) AS events FROM ce WHERE event_id % 50 <> 7 GROUP BY 1
        UNION ALL VALUES ('2024-02-01-0.json.gz 00', 'truncated', 0), ('2024-02-01-1.json.gz 01', 'not gzip', 0)""",
    "corrupt_lines": f"SELECT {BROKEN} AS line FROM ce WHERE event_id % 50 = 7",
    "hour_range": """SELECT unnest(range(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour
        FROM events""",
    "hour_range_back": """SELECT unnest(range(date_trunc('hour', max(ts)) - INTERVAL 6 HOUR, date_trunc('hour', max(ts)),
        INTERVAL 1 HOUR)) AS hour FROM events""",
    "events_in_hours": f"SELECT event_id, ts FROM events WHERE {IN_HOURS}",
    "latest_hour": """SELECT date_trunc('hour', max(ts)) AS latest_hour FROM events
        WHERE ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
    "archive_hour_path": """SELECT DISTINCT strftime(ts, '%Y-%m-%d-%H') || '.json.gz' AS path, date_trunc('hour', ts) AS hour
        FROM events""",
    "read_findings": f"""SELECT {pick(DETECTOR_CATALOG[:7], 'doc_id')} AS detector, CAST(doc_id % 9 AS VARCHAR) AS detector_type,
        'PLAIN' AS decoder, doc_id % 3 = 0 AS verified, doc_id % 3 = 2 AS redacted,
        CASE WHEN has_raw THEN {red("('fake-value-' || doc_id)")} ELSE '' END AS secret_redacted,
        CASE WHEN has_raw THEN {fp("('fake-value-' || doc_id)")} ELSE '' END AS secret_fp,
        CASE WHEN git THEN md5(CAST(doc_id AS VARCHAR)) ELSE '' END AS commit,
        CASE WHEN git THEN source || '.txt' ELSE '/tmp/' || source END AS file,
        CASE WHEN git THEN 'd' || (doc_id % 50) || '@mail.example' ELSE '' END AS email,
        CASE WHEN git THEN '2024-01-01 00:00:' || (doc_id % 60) ELSE '' END AS "timestamp",
        CASE WHEN git THEN 'org' || (doc_id % 25) || '/docs' ELSE '' END AS repository,
        CASE WHEN git THEN 'c' ELSE '' END AS committer
        FROM (SELECT *, doc_id % 6 <> 4 AS git, doc_id % 2 = 0 OR doc_id % 5 = 1 AS has_raw FROM documents)
        WHERE doc_id % 29 <> 3 AND doc_id % 31 <> 4""",
    "write_findings_csv": """SELECT detector, coalesce(verified, false) AS verified, commit, file, repository, email
        FROM findings""",
    "write_report_json": JSON,
    "report_markdown": MARKDOWN,
    "report_text": TEXT,
    "report_text_errors": f"""{TEXT} UNION ALL SELECT 7, unnest([0, 1]), unnest(['', '  Errors (' || (SELECT count(*) FROM ce WHERE event_id % 50 = 7) || '):'])
        UNION ALL SELECT 8, row_number() OVER (ORDER BY line) - 1, '    ! ' || line
        FROM (SELECT {BROKEN} AS line FROM ce WHERE event_id % 50 = 7 ORDER BY line LIMIT 5)""",
    "write_domain_list": "SELECT 'pages' AS source, count(*) AS count FROM found_domains",
    "read_domain_list": "SELECT domain FROM found_domains",
    "extract_domains": "SELECT domain FROM found_domains",
    "union_domain_lists": "SELECT domain FROM found_domains UNION SELECT domain FROM mails",
    "write_by_hour": f"SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour FROM events WHERE {IN_HOURS}",
    # projections and filters
    "push_events": "SELECT * FROM pushes",
    "pr_events": "SELECT * FROM prs",
    "union_events": """SELECT event_id, event_type, repo, ts, head, '' AS title FROM pushes
        UNION ALL SELECT event_id, event_type, repo, ts, '', title FROM prs""",
    "commit_key": "SELECT * FROM keyed",
    "first_line": f"SELECT event_id, {first_line('message')} AS line FROM ce",
    "message_by_forge": f"""SELECT event_id, {pick(["github", "gitlab", "bitbucket", "azure_devops", "sourceforge", "gitea"],
        'event_id')} AS forge, {first_line('message')} AS message FROM ce""",
    "assemble_diff": f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'gitlab' WHEN 2 THEN 'azure_devops' WHEN 3 THEN 'github'
          ELSE 'bitbucket' END AS forge,
        CASE doc_id % 5 WHEN 0 THEN {GITLAB_DIFF} WHEN 2 THEN {GIT_HEAD.format(a=NEW, b=NEW)} || {PATCH} WHEN 3 THEN {PATCH}
          ELSE {GIT_HEAD.format(a=OLD, b=NEW)} || {PATCH} END AS diff FROM documents""",
    "diff_lines": "SELECT * FROM changed WHERE sign <> ' '",
    "diff_added_lines": "SELECT * FROM added",
    "suspicious_only": "SELECT event_id, repo, sha, message FROM suspicious",
    "only_verified": "SELECT detector, commit, secret_fp, pos FROM findings WHERE verified",
    "skip_diffs": "SELECT classification, count(*) AS commits FROM classified GROUP BY classification",
    "sample_commits": """SELECT event_id, repo, sha FROM keyed
        WHERE CAST('0x' || left(md5(repo || '@' || sha), 8) AS BIGINT) < 0.3 * 4294967296""",
    "sample_by_hash": """SELECT event_id, repo, sha FROM keyed
        WHERE CAST('0x' || left(md5('7:' || event_id), 8) AS BIGINT) < 0.3 * 4294967296""",
    "max_commits": "SELECT event_id, repo, sha, ts FROM suspicious ORDER BY ts, repo, sha, event_id LIMIT 25",
    # classification
    "message_key": "SELECT event_id, message_key FROM msgs",
    "match_removal_patterns": f"SELECT event_id, CASE {when_patterns('message_key', range(1, 4))} END AS rule_id FROM msgs",
    "match_sweep_patterns": f"SELECT event_id, CASE {when_patterns('message_key', range(4, 13))} END AS rule_id FROM msgs",
    "tokenize": f"SELECT event_id, unnest({tokens_of('message_key')}) AS token FROM msgs",
    "tier1": f"SELECT event_id, {tier1_of(tokens_of('message_key'))} AS hit FROM msgs",
    "tier2": f"SELECT event_id, {tier2_of(tokens_of('message_key'))} AS hit FROM msgs",
    "classify": LABELLED.format(code=code_of("message_key")),
    "classify_with_rules": LABELLED.format(code=code_of("message_key", CUSTOM_WORDS)),
    "classify_with_rule_table": LABELLED.format(code=code_of("message_key", CUSTOM_WORDS)),
    "classify_batch": "SELECT event_id, repo, sha, classification FROM classified",
    "score_unresolved": f"""SELECT event_id, CASE WHEN code > 0 OR (code = 0 AND said_yes) THEN 'suspicious' ELSE 'clean' END
          AS classification,
        CASE code WHEN -1 THEN 'blank' WHEN 0 THEN 'model' WHEN 101 THEN 'tier1' WHEN 102 THEN 'tier2' ELSE 'pattern' END AS tier,
        CASE WHEN code BETWEEN 1 AND 12 THEN code END AS rule_id
        FROM (SELECT event_id, {code_of('message_key')} AS code,
                ends_with(message_key, 'e') OR contains(message_key, 'env') AS said_yes FROM msgs)""",
    "classifier_stats": f"""SELECT count(*) FILTER (code BETWEEN 1 AND 12) AS patterns, count(*) FILTER (code = 101) AS regex_tier1,
        count(*) FILTER (code = 102) AS regex_tier2, count(*) FILTER (code = 0) AS llm,
        CAST(sum(n) - count(*) AS BIGINT) AS cache_hit
        FROM (SELECT *, {code_of('message_key')} AS code FROM (SELECT message_key, count(*) AS n FROM msgs GROUP BY 1)
              WHERE message_key <> '')""",
    "build_review_prompt": f"SELECT event_id, replace({q(rules.REVIEW_PROMPT)}, '{{commit_message}}', {redacted('message')}) AS prompt FROM msgs",
    "build_review_batches": "SELECT batch_id, messages, prompt FROM batches",
    "parse_review_verdicts": """SELECT CAST(event_id AS VARCHAR) AS batch_id, unnest([0, 1, k + 2]) AS idx,
        unnest([true, k % 2 = 0, false]) AS leak_fix FROM ce WHERE event_id % 4 <> 3""",
    "apply_review_verdicts": """SELECT batch_id, idx, message_key,
        CASE WHEN idx IN (0, 3) AND length(prompt) % 3 <> 0 THEN 'suspicious' ELSE 'clean' END AS classification
        FROM (SELECT n.*, b.prompt FROM numbered n JOIN batches b USING (batch_id))""",
    "apply_single_replies": """SELECT event_id, CASE WHEN event_id % 9 = 4 THEN 'ambiguous' WHEN event_id % 4 < 2 THEN 'suspicious'
        ELSE 'clean' END AS classification FROM ce""",
    "credential_kind_by_prefix": f"""SELECT event_id, {pick(['anthropic', 'openai', 'gemini', 'openai'], 'event_id')} AS kind
        FROM ce""",
    # attribution
    "org_handle": "SELECT event_id, coalesce(org_handle, 'unknown') AS org_handle FROM org_hits",
    "attribute_by_org": "SELECT event_id, org_handle, org_owned FROM org_hits",
    "email_domain": f"""SELECT CAST(event_id AS VARCHAR) AS id, pos, {domain_of('author')} AS author,
        {domain_of('committer')} AS committer FROM emails""",
    "attribute_by_email": "SELECT event_id, via AS matched_via, domain AS matched_value FROM mail_hits",
    "attribute_events": "SELECT id, org_handle, is_owned, matched_via, matched_value, label FROM attributed",
    "attribute_events_by_list": "SELECT id, org_handle, is_owned, matched_via, matched_value, label FROM attributed",
    "owned_only": "SELECT id, label FROM attributed WHERE is_owned",
    "not_owned": """SELECT id, CASE WHEN label = 'unknown' THEN label ELSE 'non-enterprise' END AS label
        FROM attributed WHERE NOT is_owned""",
    # joins and sets
    "resolve_messages": "SELECT event_id, repo, sha, is_pr, message FROM resolved",
    "unresolved_pushes": """SELECT event_id, repo, sha FROM keyed WHERE NOT is_pr
        AND event_id NOT IN (SELECT event_id FROM resolved)""",
    "attach_diffs": "SELECT * FROM attached",
    "one_commit": "SELECT repo, sha, diff FROM diffs ORDER BY sha, repo LIMIT 1",
    "distinct_commits": """SELECT repo, sha, event_id, ts, ref FROM (SELECT *,
        row_number() OVER (PARTITION BY repo, sha ORDER BY ts, event_id) AS rn FROM keyed) WHERE rn = 1""",
    # detection
    "detect_secrets": f"SELECT doc_id, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp FROM doc_hits",
    "detect_every_kind": f"""SELECT doc_id, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp FROM (
        {hits(f"(SELECT doc_id, text || {NL} || {pick(INVENTED, 'doc_id')} || ' end' AS text FROM documents)", 'doc_id')})""",
    "detect_in_pages": f"SELECT page_id, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp FROM page_hits",
    "detect_in_conversations": f"""SELECT conv_id, turn, detector, pos, {red('value')} AS secret_redacted,
        {fp('value')} AS secret_fp FROM ({hits('conversations', 'conv_id, turn')})""",
    "secret_entropy": f"SELECT doc_id, detector, pos, round(entropy, 6) AS entropy, {fp('value')} AS secret_fp FROM ({{entropy}})",
    "entropy_filter": f"""SELECT doc_id, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp
        FROM ({{entropy}}) WHERE entropy >= 3.7""",
    "redact_text": f"SELECT doc_id, {redacted('text')} AS text FROM documents",
    "secret_fingerprint": f"SELECT event_id, {fp('sha')} AS secret_fp, {red('sha')} AS secret_redacted FROM ce",
    "detector_coverage": f"""SELECT c.detector, count(f.detector) AS findings
        FROM (SELECT unnest({sql_list(DETECTOR_CATALOG + GENERIC_DETECTORS)}) AS detector) c
        LEFT JOIN findings f ON c.detector = f.detector GROUP BY c.detector""",
    "clean_documents": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_hits)",
    "scan_hours": """SELECT * FROM ({scan}) WHERE (repo, sha) IN (SELECT (s.repo, s.sha) FROM suspicious s
        WHERE s.ts >= TIMESTAMP '2024-01-10' AND s.ts < TIMESTAMP '2024-01-12') AND (repo, sha) IN (SELECT (repo, sha) FROM keyed
        WHERE NOT is_pr GROUP BY repo, sha HAVING date_trunc('hour', min(ts)) >= TIMESTAMP '2024-01-08' AND min(ts) < TIMESTAMP '2024-01-12')""",
    "scan_one": f"""SELECT repo, sha, file, line_no, sign, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp
        FROM ({hits("""(SELECT a.* FROM changed a JOIN (SELECT p.repo, p.sha FROM push_keys p WHERE (p.user_id * 100 + p.k) % (SELECT count(*) FROM documents)
          IN (SELECT doc_id FROM doc_hits) AND len(string_split(p.repo, '/')) = 2 ORDER BY p.sha, p.repo LIMIT 1) w
          ON a.repo = w.repo AND a.sha = w.sha WHERE sign <> chr(32))""", 'repo, sha, file, line_no, sign')})""",
    "scan": "{scan}",
    "scan_owned": """SELECT * FROM ({scan}) WHERE (repo, sha) IN (SELECT (s.repo, s.sha) FROM suspicious s
        JOIN attributed a ON a.event_id = s.event_id WHERE a.is_owned)""",
    # windows, limits, order
    "first_seen_key": """SELECT event_id, message_key,
        row_number() OVER (PARTITION BY message_key ORDER BY ts, event_id) > 1 AS cache_hit FROM msgs""",
    "top_detectors": "SELECT * FROM verified_counts ORDER BY findings DESC, detector LIMIT 10",
    "sample_findings": "SELECT detector, repository, commit, file FROM sampled20 WHERE rn <= 5",
    "suspicious_listing": "SELECT * FROM listed",
    "first_errors": f"""SELECT (SELECT count(*) FROM ce WHERE event_id % 50 = 7) AS errors, line
        FROM (SELECT {BROKEN} AS line FROM ce WHERE event_id % 50 = 7 ORDER BY line LIMIT 5)""",
    "ordered_results": "SELECT ts, event_id, classification FROM classified ORDER BY ts, event_id",
    # aggregates
    "run_summary": "SELECT * FROM summary",
    "detector_counts": "SELECT detector, count(*) AS findings FROM findings GROUP BY detector",
    "first_seen_odd_ids": "SELECT repo || '@' || sha AS commit, count(*) AS events, count(*) - 1 AS hits, min(ts) AS first_ts FROM keyed GROUP BY 1",
    "review_batches_full": f"""SELECT CAST(n // 10 AS VARCHAR) AS batch_id, count(*) AS messages,
        replace({q(rules.REVIEW_BATCH_PROMPT)}, '{{messages}}',
          string_agg('[' || (n % 10) || '] ' || {redacted('message_key')}, {NL} || '---' || {NL} ORDER BY n)) AS prompt
        FROM (SELECT message_key, row_number() OVER (ORDER BY CAST('0x' || left(md5(message_key), 8) AS BIGINT)
          % CAST(ceil((SELECT count(*) FROM open_keys) / 100.0) AS BIGINT), message_key) - 1 AS n FROM open_keys) GROUP BY n // 10""",
    "finding_distincts_merged": """SELECT count(*) AS total_findings, count(*) FILTER (verified) AS verified_count,
        true AS unique_files, true AS unique_emails, true AS unique_repos FROM findings""",
    "finding_distincts": """SELECT count(*) AS total_findings, count(*) FILTER (verified) AS verified_count,
        count(DISTINCT nullif(file, '')) AS unique_files, count(DISTINCT nullif(email, '')) AS unique_emails,
        count(DISTINCT nullif(repository, '')) AS unique_repos FROM findings""",
    "finding_repositories": "SELECT DISTINCT repository FROM findings WHERE repository <> ''",
    "hourly_counts": """SELECT date_trunc('hour', ts) AS hour, count(*) AS events,
        count(*) FILTER (kind = 'PushEvent') AS pushes, count(*) FILTER (kind = 'PullRequestEvent') AS prs
        FROM ce GROUP BY 1""",
    "verified_detector_table": "SELECT * FROM verified_counts",
    # scalars
    "short_sha": "SELECT event_id, left(sha, 12) AS sha FROM ce",
    "truncate_ellipsis": "SELECT doc_id, " + ", ".join(
        f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '...' ELSE text END AS cut{n}" for n in (50, 60, 120))
        + " FROM documents",
    "shorten_words": f"SELECT doc_id, {shorten('text')} AS short FROM documents",
    "repo_url_parts": "SELECT * FROM url_parts",
    "forge_of_host": f"SELECT id, {forge_of('host')} AS forge FROM url_parts",
    "azure_project_repo": """SELECT id, CASE WHEN contains(repo, '/_git/') THEN left(repo, instr(repo, '/_git/') - 1) ELSE repo END
        AS project, CASE WHEN contains(repo, '/_git/') THEN substr(repo, instr(repo, '/_git/') + 6) ELSE repo END AS repo
        FROM url_parts""",
    "clone_url": "SELECT event_id, 'https://' || " + by_case(
        "forge", {f: q(h) for f, h in rules.CLONE_HOSTS.items()}, "forge") + " || '/' || repo || '.git' AS url FROM forged",
    "commit_url": f"SELECT event_id, {API} || {OF_COMMIT} AS url FROM forged",
    "diff_url": f"""SELECT event_id, {API} || CASE WHEN starts_with(sha, 'pr-') THEN {DIFF_OF_PULL} ELSE {DIFF_OF_COMMIT} END AS url
        FROM forged""",
    "finding_label": """SELECT secret_fp, pos, '[' || CASE WHEN verified THEN 'VERIFIED' ELSE 'unverified' END || '] ' || detector
        || ' in ' || file || ' @ ' || left(commit, 12) AS label FROM findings""",
    "dash_if_empty": "SELECT event_id, coalesce(nullif(repo, ''), '—') AS repo FROM ce",
    "thousands": "SELECT event_id, format('{:,}', event_id * 1234) AS n FROM ce",
    "run_duration": """SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'running'
        ELSE (date_diff('microsecond', min(ts), max(ts)) // 1000000) || 's' END AS duration FROM ce GROUP BY user_id""",
    # streaming
    "monitor_stream": "SELECT event_id, repo, sha, tier, rule_id FROM suspicious",
    "monitor_dedup": "SELECT DISTINCT repo, sha FROM keyed",
    "hourly_window_counts": """SELECT date_trunc('hour', ts) AS hour, kind, count(*) AS events FROM ce
        WHERE date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM ce) GROUP BY ALL""",
    "monitor_attribution": "SELECT id, org_handle, is_owned, matched_via, matched_value, label FROM attributed",
    "monitor_findings": f"""SELECT f.*, secret_fp IN (SELECT secret_fp FROM findings WHERE verified) AS alert
        FROM (SELECT repo, sha, file, line_no, sign, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp
        FROM ({hits('(SELECT a.* FROM changed a JOIN live_wanted w ON a.repo = w.repo AND a.sha = w.sha WHERE has_diff AND sign <> chr(32))', 'repo, sha, file, line_no, sign')})) f""",
    "monitor_waiting": """SELECT 'commit' AS lacks, CAST(event_id AS VARCHAR) AS event_id, repo, sha FROM live WHERE message IS NULL
        UNION ALL SELECT 'diff', '', repo, sha FROM live_wanted WHERE NOT has_diff""",
    "late_rows": """SELECT CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'late'
          WHEN date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM ce) THEN 'closed' ELSE 'open' END AS state,
          date_trunc('hour', ts) AS hour, kind, count(*) AS events FROM ce GROUP BY ALL""",
    "alert_stream": "SELECT detector, commit, secret_fp, pos FROM findings WHERE verified",
    "late_data": """SELECT date_trunc('hour', ts) AS hour, kind, count(*) AS events FROM ce
        WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'
          AND date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM ce) GROUP BY ALL""",
}

# Bits per character: every distinct character with its share of the value.
ENTROPY = """SELECT *, -list_sum(list_transform(list_distinct(string_split(value, '')), lambda c:
    ((length(value) - length(replace(value, c, ''))) / length(value))
    * log2((length(value) - length(replace(value, c, ''))) / length(value)))) AS entropy FROM doc_hits"""

# Findings in the changed lines of the diffs of suspicious commits.
SCAN = f"""SELECT repo, sha, file, line_no, sign, detector, pos, {red('value')} AS secret_redacted, {fp('value')} AS secret_fp
    FROM ({hits('(SELECT a.* FROM changed a JOIN wanted w ON a.repo = w.repo AND a.sha = w.sha WHERE sign <> chr(32))', 'repo, sha, file, line_no, sign')})"""


def all_sql() -> dict[str, str]:
    return {name: sql(body.replace("{entropy}", ENTROPY).replace("{scan}", SCAN)) for name, body in BODIES.items()}
