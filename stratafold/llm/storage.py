"""Tables that cut a lineage, in the folder that all executors share."""

from stratafold.operators.storage import clear_stored, dropped, shared_folder, stored

__all__ = ["clear_stored", "dropped", "shared_folder", "stored"]
