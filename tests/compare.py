"""Order-free comparison of result frames."""

import numpy as np
import pandas as pd


def plain(v):
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        return None if v != v else float(v)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is pd.NaT or v is pd.NA:
        return None
    return v


def rows_of(frame: pd.DataFrame):
    cols = sorted(frame.columns)
    out = [tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__ in ("str",)), str(v)) for v in r))
