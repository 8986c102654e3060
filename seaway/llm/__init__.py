"""Training-data operators over passage plans and other texts the engine stores. Nothing outside this folder imports it."""
