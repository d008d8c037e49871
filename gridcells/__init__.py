"""gridcells: labelled gridded data as long cell tables on Spark."""

from gridcells.model import GridDataset, GridTable  # noqa: F401
from gridcells.session import build_session, checkpoint_dir, scratch_path  # noqa: F401
