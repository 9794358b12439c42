"""All registered queries of the image-corpus toolkit and their SQL."""
from . import q_images, q_io, q_manifest, q_plans

_MODULES = (q_images, q_manifest, q_plans, q_io)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
