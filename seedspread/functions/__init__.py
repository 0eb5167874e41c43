from seedspread.functions.hashing import hash_bucket, order_key
from seedspread.functions.vectors import edge_weight, scale, sq_dist, to_double_array

__all__ = ["hash_bucket", "order_key", "edge_weight", "scale", "sq_dist", "to_double_array"]
