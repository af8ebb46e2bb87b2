"""Safety of links as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_href(raw: Column) -> Column:
    """The normalised link if it is safe to follow, else null.

    Control characters and spaces around it and tabs and line ends inside it, which browsers ignore, are
    taken out first. Web and mail links, paths of the own site and fragments are safe; links that begin with
    two slashes and all other schemes are not.
    """
    href = F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    good = href.rlike(r"^/(?!/)") | href.startswith("#") | href.rlike(r"^(?i:https?|mailto):")
    return F.when(good, href)


def is_external(href: Column) -> Column:
    """Whether a safe link leaves the site."""
    return href.rlike(r"^(?i:https?:)")
