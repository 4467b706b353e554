"""Source text as relations: definitions, imports, mentions; resolution to call edges is done by joins."""
