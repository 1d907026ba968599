from .tables import (preview, read_features, read_interactions, read_items, require_columns,
                     schema_profile, write_csv, write_features)

__all__ = ["preview", "read_features", "read_interactions", "read_items", "require_columns",
           "schema_profile", "write_csv", "write_features"]
