"""chainlake: ordered block delivery as Spark DataFrame and streaming jobs.

Blocks are stored by chain and height in a hot and a cold tier; webhooks
(subscriptions) hold cursors; every round plans, for all webhooks at once,
which height ranges are due and builds the delivery requests in order.
Billing events drive entitlement decisions.  See README.md.
"""

__version__ = "0.1.0"
