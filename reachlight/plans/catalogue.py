"""The rule catalogue and the vocabularies, as data. Within a rule the order of patterns has no meaning."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """kind: how it matches. Lower priority wins, then the earlier rule."""

    id: str
    category: str
    severity: str
    kind: str
    priority: int = 20
    patterns: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    constructors: tuple[str, ...] = ()
    hops: tuple[str, ...] = ()
    escalates: tuple[str, ...] = ()
    description: str = ""
    language: str = "python"
    tags: tuple[str, ...] = field(default=("CWE-862", "LLM06"))


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


RULES = (
    Rule("PAY-STRIPE-REFUND", "payments", "high", "attr", 20, patterns=_words("charge create payout refund capture transfer"), modules=_words("stripe stripe.Charge stripe.Payout stripe.Refund stripe.Transfer"), description="moves money", tags=("CWE-862", "LLM06")),
    Rule("PAY-GENERIC-REFUND", "payments", "high", "name", 20, patterns=_words("charge payout refund capture transfer issue_refund create_charge create_refund process_refund"), description="moves money", tags=("CWE-862", "LLM06")),
    Rule("PAY-BRAINTREE", "payments", "high", "attr", 20, patterns=_words("sale void refund capture"), modules=_words("adyen paypal braintree"), description="moves money", tags=("CWE-862", "LLM06")),
    Rule("DATA-DELETE-SQL", "data_destruction", "high", "sql", 30, patterns=("\\bDELETE\\s+FROM\\b", "\\bDROP\\s+(TABLE|DATABASE)\\b"), description="destroys data", tags=("CWE-862", "LLM06")),
    Rule("DATA-DELETE-SQL-RAW", "data_destruction", "high", "text", 30, patterns=("\\bDELETE\\s+FROM\\b", "\\bDROP\\s+(TABLE|DATABASE)\\b"), description="destroys data", tags=("CWE-862", "LLM06")),
    Rule("DATA-DELETE-FILE", "data_destruction", "high", "name", 20, patterns=_words("drop delete remove rmtree unlink destroy"), description="destroys data", tags=("CWE-862", "LLM06")),
    Rule("DATA-DELETE-OS", "data_destruction", "high", "attr", 20, patterns=_words("rmdir remove rmtree unlink removedirs"), modules=_words("os Path shutil pathlib"), description="destroys data", tags=("CWE-862", "LLM06")),
    Rule("DATA-DELETE-OBJ", "data_destruction", "high", "qualified", 20, patterns=_words("db.delete session.merge objects.delete objects.remove session.delete db.session.delete"), description="destroys data", tags=("CWE-862", "LLM06")),
    Rule("DEPLOY-SUBPROCESS", "deployment", "high", "deploy", 30, description="changes a deployment", tags=("CWE-78", "LLM06")),
    Rule("ACCESS-CONTROL-MUTATE", "access_control", "high", "attr", 20, patterns=_words("assign_role create_role create_user rotate_keys create_policy put_role_policy put_user_policy add_user_to_group create_access_key attach_role_policy attach_user_policy update_permissions update_assume_role_policy"), modules=_words("iam role user group policy"), description="changes access rights", tags=("CWE-862", "LLM06")),
    Rule("COMMUNICATION-SEND", "communication", "medium", "qualified", 20, patterns=_words("send_sms sendmail send_email Emails.send emails.send sns.publish post_message send_message send_raw_email ses.send_email chat_postMessage ses.send_raw_email slack.post_message slack.chat_postMessage twilio.messages.create WebClient.chat_postMessage webclient.chat_postMessage"), excluded=_words("Runtime runtime EventBus WsBridge wsbridge A2AClient event_bus MessageBus a2a_client AgentClient message_bus agent_client"), description="sends a message", tags=("CWE-862", "LLM06")),
    Rule("EMAIL-PROVIDER-SEND", "communication", "medium", "qualified", 15, patterns=_words("send messages.create"), constructors=_words("MailgunClient mailgun.Client SendGridAPIClient sendgrid.SendGridAPIClient"), hops=_words("messages"), description="sends a message", tags=("CWE-862", "LLM06")),
    Rule("COMMUNICATION-SEND-NAME", "communication", "medium", "name", 20, patterns=_words("notify sendmail broadcast send_email post_message send_message"), excluded=_words("Runtime runtime EventBus WsBridge wsbridge A2AClient event_bus MessageBus a2a_client AgentClient message_bus agent_client"), description="sends a message", tags=("CWE-862", "LLM06")),
    Rule("PROVIDER-SDK-CALL", "provider_sdk", "medium", "attr", 20, patterns=_words("create create_repo create_user delete_blob delete_file delete_item delete_repo delete_role delete_user create_issue delete_queue delete_stack delete_table delete_topic create_branch delete_bucket delete_object delete_policy delete_objects stop_instances delete_function delete_instance delete_access_key delete_db_cluster delete_db_instance create_pull_request terminate_instances"), modules=_words("s3 ec2 gcp rds azure boto3 github lambda octokit storage"), description="acts through a cloud provider", tags=("CWE-862", "LLM06")),
    Rule("DATABASE-MUTATE", "database_mutation", "high", "sql", 30, patterns=("\\bINSERT\\s+INTO\\b", "\\bUPDATE\\s+.*\\s+SET\\b", "\\bTRUNCATE\\b"), description="changes a database", tags=("CWE-862", "LLM06")),
    Rule("DATABASE-ORM-MUTATE", "database_mutation", "medium", "qualified", 20, patterns=_words("session.add Model.create Model.delete filter.create prisma.create prisma.delete prisma.update session.flush session.merge objects.create objects.delete objects.update session.delete objects.bulk_create objects.bulk_update"), description="changes a database", tags=("CWE-862", "LLM06")),
    Rule("IDENTITY-CHANGE", "identity_change", "high", "name", 20, patterns=_words("assign_role create_user rotate_keys update_permissions"), description="changes identities", tags=("CWE-862", "LLM06")),
    Rule("IDENTITY-IAM-MUTATE", "identity_change", "high", "attr", 20, patterns=_words("create_role create_user delete_role delete_user update_role update_user create_group delete_group create_policy delete_policy update_policy put_role_policy put_user_policy add_user_to_group create_access_key delete_access_key attach_role_policy attach_user_policy remove_user_from_group update_assume_role_policy"), modules=_words("iam role user group policy"), description="changes identities", tags=("CWE-862", "LLM06")),
    Rule("DEPLOY-K8S", "deployment", "high", "qualified", 20, patterns=_words("kubectl.apply kubectl.patch kubectl.scale kubectl.create kubectl.delete kubectl.replace kubectl.rollout create_namespaces delete_namespaces patch_namespaced_pod create_namespaced_job create_namespaced_pod delete_namespaced_pod replace_namespaced_pod patch_namespaced_secret create_namespaced_secret delete_namespaced_secret create_namespaced_service delete_namespaced_service create_namespaced_cron_job replace_namespaced_service patch_namespaced_config_map patch_namespaced_deployment create_namespaced_config_map create_namespaced_daemon_set create_namespaced_deployment delete_namespaced_config_map delete_namespaced_deployment replace_namespaced_deployment create_namespaced_stateful_set CoreV1Api.create_namespaced_pod CoreV1Api.delete_namespaced_pod BatchV1Api.create_namespaced_job CoreV1Api.create_namespaced_service AppsV1Api.create_namespaced_deployment kubernetes.client.delete_namespaced_pod kubernetes.client.create_namespaced_deployment"), description="changes a deployment", tags=("CWE-78", "LLM06")),
    Rule("DEPLOY-TERRAFORM", "deployment", "high", "deploy", 30, description="changes a deployment", tags=("CWE-78", "LLM06")),
    Rule("EXEC-CODE", "code_execution", "high", "qualified", 10, patterns=_words("eval exec"), description="executes code", tags=("CWE-94", "LLM06")),
    Rule("EXEC-SHELL", "shell_execution", "high", "qualified", 10, patterns=_words("os.execv os.popen os.execve os.spawnl os.spawnv os.system pty.spawn os.spawnle os.spawnvp subprocess.run subprocess.call subprocess.Popen subprocess.check_call subprocess.check_output asyncio.create_subprocess_exec asyncio.create_subprocess_shell"), description="executes a command", tags=("CWE-78", "LLM06")),
    Rule("EXEC-CONTAINER", "code_execution", "high", "qualified", 10, patterns=_words("containers.get containers.run containers.create container.exec_run containers.exec_run"), description="executes code", tags=("CWE-94", "LLM06")),
    Rule("BROWSER-ACTION", "browser_action", "high", "qualified", 10, patterns=_words("page.fill page.goto page.type driver.get frame.fill frame.goto frame.type page.check page.click page.press frame.click frame.press page.submit driver.click locator.fill page.uncheck element.click locator.click locator.press page.navigate element.submit element.send_keys page.select_option driver.find_element page.set_input_files"), description="acts in a browser", tags=("CWE-862", "LLM06")),
    Rule("FILE-WRITE", "file_mutation", "high", "qualified", 10, patterns=_words("os.chmod os.chown os.rename Path.chmod os.replace os.symlink Path.rename shutil.copy shutil.move Path.replace shutil.copy2 shutil.rmtree Path.symlink_to Path.write_text shutil.copyfile Path.write_bytes"), description="changes files", tags=("CWE-73", "LLM06")),
    Rule("FILE-OPEN-WRITE", "file_mutation", "high", "open", 10, description="changes files", tags=("CWE-73", "LLM06")),
    Rule("NET-EGRESS", "network_egress", "medium", "qualified", 10, patterns=_words("httpx.put client.put httpx.post aiohttp.put client.post httpx.patch session.put aiohttp.post client.patch httpx.delete requests.put session.post aiohttp.patch client.delete requests.post session.patch aiohttp.delete requests.patch session.delete requests.delete urllib.request.urlopen"), escalates=_words("endpoint uri url"), description="sends data out", tags=("CWE-918", "LLM06")),
    Rule("GIT-MUTATE", "vcs_mutation", "high", "qualified", 10, patterns=_words("git.push git.reset repo.push git.commit repo.reset origin.push remote.push repo.commit repo.index.commit"), description="changes version control", tags=("CWE-862", "LLM06")),
    Rule("REPOSITORY-MUTATION", "repository_mutation", "high", "qualified", 10, patterns=_words("edit delete create_file create_pull delete_file update_file create_git_ref create_git_tag create_git_release get_git_ref.delete"), constructors=_words("Github Auth.Login github.Github github.Auth.Login github.MainClass.Github"), hops=_words("get_pull get_repo get_user get_branch create_pull get_git_ref create_git_ref get_organization"), description="changes a hosted repository", tags=("CWE-862", "LLM06")),
    Rule("GITHUB-REST-MUTATION", "repository_mutation", "high", "rest", 5, description="changes a hosted repository", tags=("CWE-862", "LLM06")),
    Rule("SECRET-READ", "credential_access", "high", "qualified", 10, patterns=_words("get_secret read_secret get_parameter get_secret_value read_secret_data"), description="reads credentials", tags=("CWE-200", "LLM06")),
    # TypeScript and JavaScript
    Rule("PAY-STRIPE-REFUND", "payments", "high", "qualified", patterns=tuple("stripe." + p for p in _words("charges.create charges.refund payouts.create refunds.create transfers.create paymentIntents.cancel paymentIntents.create paymentIntents.capture")), description="moves money", language="typescript"),
    Rule("PAY-GENERIC-REFUND", "payments", "high", "name", patterns=_words("refund issueRefund createCharge createRefund processRefund"), description="moves money", language="typescript"),
    Rule("EXEC-SHELL", "shell_execution", "high", "qualified", 19, patterns=_words("execSync spawnSync execFileSync cp.exec cp.spawn child_process.exec child_process.spawn child_process.execSync child_process.spawnSync"), description="executes a command", tags=("CWE-78", "LLM06"), language="typescript"),
    Rule("EXEC-SHELL", "shell_execution", "high", "name", 19, patterns=_words("exec spawn"), description="executes a command", tags=("CWE-78", "LLM06"), language="typescript"),
    Rule("DATA-DELETE-FILE", "file_mutation", "high", "qualified", patterns=("rimraf", *("fs." + p for p in _words("rm rmdir rmSync unlink rmdirSync unlinkSync promises.rm promises.rmdir promises.unlink"))), description="destroys data", language="typescript"),
    Rule("FILE-WRITE", "file_mutation", "medium", "qualified", patterns=tuple("fs." + p for p in _words("writeFile appendFile writeFileSync appendFileSync promises.writeFile promises.appendFile")), description="changes files", tags=("CWE-73", "LLM06"), language="typescript"),
    Rule("DATA-DELETE-SQL", "data_destruction", "high", "qualified", patterns=_words("db.run db.query knex.del db.execute knex.delete cursor.execute mongoose.remove prisma.deleteMany prisma.$executeRaw connection.execute mongoose.deleteMany"), description="destroys data", language="typescript"),
    Rule("PROVIDER-SDK-CALL", "provider_sdk", "high", "qualified", patterns=(*(p + "Command" for p in _words("DeleteStack DeleteTable DeleteBucket DeleteObject DeleteObjects DeleteFunction StopInstances DeleteDBInstance TerminateInstances")), *_words("s3.deleteBucket s3.deleteObject s3.deleteObjects rds.deleteDBInstance dynamodb.deleteTable lambda.deleteFunction ec2.terminateInstances")), description="acts through a cloud provider", language="typescript"),
    Rule("NET-EGRESS", "network_egress", "medium", "qualified", 21, patterns=_words("got.put got.post got.delete axios.put axios.post axios.patch axios.delete self.fetch http.request window.fetch https.request globalThis.fetch"), description="sends data out", tags=("CWE-918", "LLM06"), language="typescript"),
    Rule("NET-EGRESS", "network_egress", "medium", "name", 21, patterns=("fetch",), description="sends data out", tags=("CWE-918", "LLM06"), language="typescript"),
    # Go
    Rule("EXEC-SHELL-GO", "shell_execution", "high", "qualified", patterns=_words("syscall.Exec exec.Command syscall.ForkExec exec.CommandContext"), description="executes a command", tags=("CWE-78", "LLM06"), language="go"),
    Rule("DATA-DELETE-OS-GO", "data_destruction", "high", "qualified", patterns=_words("os.Remove os.Truncate os.RemoveAll syscall.Rmdir syscall.Unlink"), description="destroys data", language="go"),
    Rule("FILE-WRITE-GO", "file_mutation", "medium", "qualified", patterns=_words("os.Create os.Rename os.MkdirAll os.OpenFile os.WriteFile"), description="changes files", tags=("CWE-73", "LLM06"), language="go"),
    Rule("NET-EGRESS-GO", "network_egress", "medium", "qualified", patterns=_words("http.Get http.Post http.PostForm http.NewRequest"), description="sends data out", tags=("CWE-918", "LLM06"), language="go"),
    Rule("DATA-DELETE-SQL-GO", "data_destruction", "high", "sql", patterns=(r"\bDELETE\s+FROM\b", r"\bDROP\s+(TABLE|DATABASE)\b", r"\bTRUNCATE\b"), modules=_words("conn database db pool sqlDB stmt tx"), description="destroys data", language="go"),
    Rule("PAY-STRIPE-REFUND-GO", "payments", "high", "attr", patterns=_words("New Charge Payout Refund Capture Transfer IssueRefund CreateRefund ProcessRefund"), modules=_words("stripe charges payouts refunds transfers"), description="moves money", language="go"),
    Rule("PAY-GENERIC-REFUND-GO", "payments", "high", "attr", patterns=_words("Charge Payout Refund Capture Transfer IssueRefund CreateCharge CreateRefund ProcessRefund"), modules=_words("pay adyen charge paypal payout refund square stripe billing charges payment payouts refunds payments razorpay transfer braintree transfers"), description="moves money", language="go"),
    Rule("SECRET-READ-GO", "credential_access", "high", "attr", patterns=_words("GetSecret ReadSecret GetParameter GetSecretValue ReadSecretData GetSecretString"), modules=_words("kv sm ssm svc vault client secret secrets service keyVault keyvault secretClient secretsClient parameterStore parameterstore secretsmanager"), description="reads credentials", tags=("CWE-200", "LLM06"), language="go"),
    Rule("PROVIDER-SDK-CALL-GO", "provider_sdk", "medium", "attr", patterns=(*("Delete" + p for p in _words("Blob File Item Repo Role User Queue Stack Table Topic Bucket Object Policy Objects Function Instance AccessKey DBCluster DBInstance")), *_words("StopInstances TerminateInstances")), modules=_words("gh s3 ec2 iam rds sns sqs svc repo client lambda compute storage dynamodb cloudformation"), description="acts through a cloud provider", language="go"),
)

TOOL_DECORATORS = _words("Tool StructuredTool FunctionTool tool mcp.tool app.tool server.tool Agent.tool agent.tool fast.tool structured_tool call_tool langchain_tool function_tool register_for_llm agent.tool_plain kernel_function register_function register_for_execution")
ENTRY_DECORATORS = _words("delete bp.delete app.delete router.delete route bp.route app.route router.route blueprint.route api_route app.api_route router.api_route patch app.patch router.patch get bp.get app.get router.get post bp.post app.post router.post put bp.put app.put router.put")
WRAPPERS = _words("add_node FunctionTool tool register_tool Tool.from_function StructuredTool.from_function Tool.from_defaults FunctionTool.from_defaults")
TOOL_BASES = _words("Tool MCPTool StructuredTool BaseTool FunctionTool AgentTool Action BaseAction AgentAction")
TOOL_METHODS = _words("forward execute _execute call run _run _arun")
TOOL_LISTS = _words("tools plugins functions toolkits")
FRAMEWORKS = _words("langgraph pydantic_ai openai crewai semantic_kernel autogen langchain agno mcp smolagents llama_index")
GUARD_ATTRIBUTES = _words("auth_required permission_required require_auth requires_auth requires_human_approval requires_approval requires_permission needs_confirmation requires_confirmation human_in_the_loop is_dangerous requires_consent")
GUARD_DECORATORS = _words("login_required permission_required authenticated authorized authorize require_auth requires_auth requires_approval require_permission requires_permission requires_confirmation human_in_the_loop")
GUARD_ARGUMENTS = _words("auth authorizer dependencies permission_classes authentication_classes permissions")
GUARDS = _words("audit_and_proceed confirm_proceed auth_required login_required admin_required permission_required roles_required jwt_required authz_required authenticated is_authenticated is_permitted assert_permitted allowed is_allowed assert_allowed authorized is_authorized cedar_is_authorized assert_authorized guard enforce casbin_enforce require_role has_role assert_has_role requires_role policy_engine validate_scope oauth_scope check_scope requires_scope HumanInTheLoopMiddleware verify_signature authenticate gate policy_gate Gateway.execute audit_and_execute assert_can_execute authorize cedar_authorize is_staff verify_proof experimental_toolCallStreaming require_auth check_auth requires_auth human_approval_callback cedar_check policy_check opa_eval policy_engine_eval rego_eval cedar_eval policy_eval human_approval requires_approval get_approval await_approval request_approval confirm can user_can assert_can verify_token requires_login require_admin requires_admin enforce_permission require_permission check_permission has_permission assert_has_permission requires_permission require_authentication requireConfirmation human_confirmation requires_confirmation elicitation request_elicitation enforce_authorization require_authorization check_authorization requires_authorization guard_action authorize_action confirm_action human_in_the_loop HumanApprovalCallbackHandler gatekeeper require_verified_user require_active_user can_user current_user get_current_user require_superuser is_superuser assert_authorized_for Depends requires_roles verify_mtls check_access assert_can_access has_access assert_has_access elicit server.elicit ctx.elicit checkpoint require_client_cert verify_client_cert guard_request authorize_request decode_jwt require_jwt validate_jwt verify_jwt audit_and_allow may user_may Gateway check_opa_policy enforce_policy require_api_key validate_api_key verify_api_key checkpoint_verify policy_verify require_authz")
CHECK_WORDS = _words("assert check sanitise sanitize validate verify")
RAISING = _words("audit_and_proceed confirm_proceed auth_required login_required admin_required jwt_required authz_required assert_permitted assert_allowed assert_authorized guard casbin_enforce verify_signature authenticate validate gate policy_gate audit_and_execute authorize verify_proof require_auth requires_auth policy_check human_approval confirm user_can assert_can requires_login require_admin requires_admin enforce_permission require_authentication human_confirmation elicitation request_elicitation enforce_authorization require_authorization guard_action authorize_action confirm_action human_in_the_loop can_user require_superuser verify_mtls elicit require_client_cert guard_request authorize_request require_jwt audit_and_allow user_may enforce_policy require_api_key verify require_authz")
RAISING_STARTS = _words("assert_ ensure_ enforce_ must_ require_")
DB_NAMES = _words("db engine database conn session connection cursor cur client cnx")
DB_DRIVERS = _words("psycopg2 sqlite3 cassandra mongodb pyodbc cx_Oracle asyncpg psycopg mysql pymysql pymongo redis sqlalchemy")
DB_MAKERS = _words("create_async_engine create_engine Connection Cursor connect")
DEPLOY_WORDS = _words("ansible deploy helm kubectl rollback terraform")
REST_PATHS = tuple("/" + p for p in _words("branches contents git/blobs git/commits git/refs git/tags git/trees merges pulls releases"))
TEMPORARY = _words("NamedTemporaryFile TemporaryDirectory mkdtemp mkstemp tempfile.")

#: Category: (label for people, what to do).
LABELS = {
    "access_control": ("ACCESS RIGHTS", "Check that the caller may grant this right to this subject."),
    "browser_action": ("BROWSER", "Check page and action against what the caller may do."),
    "code_execution": ("CODE EXECUTION", "Do not execute what a model wrote without a sandbox and an approval."),
    "communication": ("MESSAGES", "Check recipient and content against what the caller may send."),
    "credential_access": ("SECRETS", "Check that the caller may read this secret."),
    "data_destruction": ("DATA DESTRUCTION", "Require an authority check on the very object before it is destroyed."),
    "database_mutation": ("DATABASE CHANGES", "Check the rows and the caller before the statement runs."),
    "deployment": ("DEPLOYMENT", "Require an approval that names the change before it is deployed."),
    "file_mutation": ("FILES", "Check the path against a fixed folder before it is written."),
    "identity_change": ("ACCESS RIGHTS", "Check that the caller may change this identity."),
    "network_egress": ("NETWORK", "Check the address against an allow list."),
    "payments": ("MONEY", "Check the amount, the payee and the authority before the payment is made."),
    "provider_sdk": ("CLOUD", "Limit the credentials and check the resource before the call."),
    "repository_mutation": ("REPOSITORIES", "Require an approval before the repository changes."),
    "shell_execution": ("SHELL", "Allow listed commands only, and check each before it runs."),
    "vcs_mutation": ("REPOSITORIES", "Require an approval before history changes."),
}
