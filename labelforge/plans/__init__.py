"""Proof queries over the test tables; importing registers them all."""

from labelforge.plans import prepare_proofs  # noqa: F401
from labelforge.plans import metrics_proofs  # noqa: F401
from labelforge.plans import io_proofs  # noqa: F401
from labelforge.plans import vector_proofs  # noqa: F401
from labelforge.plans import harvest_proofs  # noqa: F401
from labelforge.plans import text_proofs  # noqa: F401
from labelforge.plans import trial_proofs  # noqa: F401
from labelforge.plans import model_proofs  # noqa: F401
from labelforge.plans import index_proofs  # noqa: F401
