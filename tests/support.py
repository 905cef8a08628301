"""What tests share."""


def plain(value):
    """A value as both engines may give it."""
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return tuple(map(plain, value)) if hasattr(value, "__len__") and not isinstance(value, str) else value


def rows(df, *columns):
    """The rows of a Spark DataFrame, as a sorted list of tuples."""
    columns = columns or df.columns
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
