"""Training-data operators: quality, mixing, tokenising, media, toxicity, URLs, chats, secrets, near copies."""
