"""Names of files, pairs and work-list entries."""

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def basename(path, strip_extension=True):
    """Last path segment, by default without its last extension.  A leading
    dot does not start an extension."""
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "") if strip_extension else name


def clean_name(s, suffix=".faa"):
    """All white space out, then one trailing suffix off."""
    bare = F.regexp_replace(_c(s), r"\s+", "")
    return F.when(
        bare.endswith(suffix), F.substring(bare, F.lit(1), F.length(bare) - len(suffix))
    ).otherwise(bare)


def pair_name(host, viral):
    return F.concat_ws("__", _c(host), _c(viral))


def percent_done(done, total):
    return F.when(_c(total) > 0, F.floor(_c(done) * 100 / _c(total))).cast("bigint")
